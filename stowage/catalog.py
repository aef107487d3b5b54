"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import attributes as A
from .operators import blocks as B
from .operators import entries as E
from .operators import layout as L
from .operators import namespace as N
from .operators import summary as M
from .plans import virtual as V
from .real import register as _register_real

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SELECT over ``virtual.CTE`` it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = V.CTE + sql
        return f

    return add


RATIO = "CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - compressed::DOUBLE * 100.0::DOUBLE / size::DOUBLE END AS ratio"


@query(f"""SELECT *, {RATIO} FROM (SELECT archive_id, count(*) FILTER (record_type IN ('file', 'chunked_file')) AS files, count(*) FILTER (record_type = 'directory') AS directories,
count(*) FILTER (record_type IN ('link', 'external_link')) AS links, CAST(sum(decompressed_length) AS BIGINT) AS size, CAST(sum(length) AS BIGINT) AS compressed FROM entries GROUP BY archive_id)""")
def archive_summary(spark, d):
    return M.archive_summary(V.entries(spark, d))


@query("SELECT archive_id, record_type, count(*) AS entries FROM entries GROUP BY ALL")
def entries_by_type(spark, d):
    return M.counts_by_type(V.entries(spark, d))


@query(f"""SELECT *, {RATIO} FROM (SELECT archive_id, path, length AS compressed, decompressed_length AS size, CAST(1 AS BIGINT) AS files FROM files
UNION ALL SELECT archive_id, NULL, CAST(sum(length) AS BIGINT), CAST(sum(decompressed_length) AS BIGINT), count(*) FROM files GROUP BY archive_id)""")
def listing_with_totals(spark, d):
    return M.listing_with_totals(V.files(spark, d))


@query("SELECT path, depth, parent, name FROM parts")
def path_components(spark, d):
    return E.with_path_parts(V.entries(spark, d).select("path"))


@query("SELECT path, replace(path, chr(31), '/') AS shown, '[' || replace(path, chr(31), '/') || CASE WHEN record_type = 'directory' THEN '/' ELSE '' END || ']' AS formatted FROM entries")
def path_display(spark, d):
    p = F.col("path")
    return V.entries(spark, d).select("path", S.display(p).alias("shown"), S.format_path(p, F.col("record_type") == "directory").alias("formatted"))


@query("SELECT path, record_type, decompressed_length FROM entries WHERE path IN (SELECT path FROM files UNION ALL SELECT path || '.none' FROM files)")
def path_exact_lookup(spark, d):
    """The path of each file, and as many that name nothing."""
    f = V.files(spark, d).select("path")
    keys = f.unionAll(f.select(F.concat("path", F.lit(".none")).alias("path")))
    return E.lookup(V.entries(spark, d).select("path", "record_type", "decompressed_length"), keys)


@query("SELECT path, record_type FROM entries WHERE starts_with(path, 'corpus' || chr(31) || 'en' || chr(31) || 'src1')")
def path_prefix_scan(spark, d):
    return E.prefix_scan(V.entries(spark, d).select("path", "record_type"), S.SEP.join(("corpus", "en", "src1")))


@query("SELECT path, record_type FROM entries WHERE starts_with(path, 'corpus' || chr(31) || 'd') ORDER BY path LIMIT 25")
def path_prefix_first(spark, d):
    return E.prefix_first(V.entries(spark, d).select("path", "record_type"), S.SEP.join(("corpus", "d")), 25)


@query("SELECT path FROM entries WHERE path = 'corpus' || chr(31) || 'fr' OR starts_with(path, 'corpus' || chr(31) || 'fr' || chr(31))")
def subtree_select(spark, d):
    return E.subtree(V.entries(spark, d), S.SEP.join(("corpus", "fr"))).select("path")


@query("SELECT parent AS directory, path, name FROM parts WHERE parent IN (SELECT path FROM dirs)")
def dir_children(spark, d):
    e = V.entries(spark, d).select("path", "record_type")
    return E.children(e, e.where("record_type = 'directory'")).select("directory", "path", "name")


@query("SELECT path, record_type FROM parts WHERE depth = 0")
def root_children(spark, d):
    return E.root_children(V.entries(spark, d)).select("path", "record_type")


@query("""SELECT p.parent, p.name, p.path FROM parts p JOIN (SELECT parent, name FROM parts WHERE doc_id IS NOT NULL UNION ALL SELECT parent, name || '.none' FROM parts WHERE doc_id IS NOT NULL) w
ON p.parent = w.parent AND p.name = w.name""")
def child_by_name(spark, d):
    """The parent and name of each file, and as many that name nothing."""
    f = E.with_path_parts(V.files(spark, d).select("path")).select("parent", "name")
    wanted = f.unionAll(f.select("parent", F.concat("name", F.lit(".none")).alias("name")))
    return E.child_by_name(V.entries(spark, d).select("path"), wanted).select("parent", "name", "path")


@query("SELECT parent, array_to_string(list(name ORDER BY name), ',') AS children FROM parts WHERE parent IS NOT NULL GROUP BY parent")
def tree_children_arrays(spark, d):
    return E.tree_arrays(V.entries(spark, d).select("path")).withColumn("children", F.array_join("children", ","))


@query("""SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS path FROM region UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), r_name || chr(31) || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + s_suppkey, r_name || chr(31) || n_name || chr(31) || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_to_paths(spark, d):
    return E.tree_paths(_tree(spark, d))


def _tree(spark, d):
    long = lambda c: c.cast("long")
    r = V.table(spark, d, "region").select(long(F.col("r_regionkey")).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = V.table(spark, d, "nation").select(long(F.col("n_nationkey") + 100).alias("id"), long(F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"))
    s = V.table(spark, d, "supplier").select(long(F.col("s_suppkey") + 1000).alias("id"), long(F.col("s_nationkey") + 100).alias("parent_id"), F.col("s_name").alias("name"))
    return r.unionByName(n).unionByName(s)


@query("SELECT path, decompressed_length AS size, compression, decompressed_length > 1024 AS chunked FROM files")
def small_file_codec(spark, d):
    n = F.col("decompressed_length")
    return V.files(spark, d).select("path", n.alias("size"), S.codec_for(n).alias("compression"), S.is_chunked(n, block=1024).alias("chunked"))


@query("SELECT path FROM entries WHERE NOT (replace(path, chr(31), '/') LIKE '%/src1/%' OR regexp_matches(path, 'doc_.[05]\\.txt$')) AND NOT starts_with(string_split(path, chr(31))[-1], '.')")
def hidden_and_excluded(spark, d):
    e = V.entries(spark, d).select("path")
    return e.where(~E.hidden(F.col("path")) & ~E.excluded(F.col("path"), ["*/src1/*", "*doc_?[05].txt"]))


@query("SELECT path, min(position) AS position, arg_min(size, position) AS size FROM site GROUP BY path")
def dedup_paths_first(spark, d):
    return E.first_of_each(V.site(spark, d), ["path"], ["position"])


@query("""SELECT position, path, coalesce(last_value(codec IGNORE NULLS) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING), 'zstd') AS codec
FROM (SELECT position, path, CASE WHEN position % 10 = 0 THEN ['stored', 'xz', 'zstd'][CAST(position // 10 % 3 AS INT) + 1] END AS codec FROM site)""")
def operand_config(spark, d):
    codec = F.when(F.col("position") % 10 == 0, F.element_at(F.array(F.lit("stored"), F.lit("xz"), F.lit("zstd")), (F.floor(F.col("position") / 10) % 3 + 1).cast("int")))
    return E.operand_config(V.site(spark, d).select("position", "path", codec.alias("codec")))


@query("SELECT archive_id, record_index, logical_offset, physical_offset FROM placed")
def block_table(spark, d):
    return B.block_table(V.chunked(spark, d)).select(*B.KEY, "logical_offset", "physical_offset")


@query("SELECT archive_id, record_index, CAST(1 + (decompressed_length - 1) // block_size AS BIGINT) AS blocks FROM chunked")
def block_counts(spark, d):
    return V.chunked(spark, d).select(*B.KEY, S.block_count(F.col("decompressed_length"), F.col("block_size")).alias("blocks"))


@query("""SELECT archive_id, record_index, logical_offset, physical_offset, coalesce(lead(physical_offset) OVER (PARTITION BY record_index ORDER BY logical_offset), data_offset + length) AS physical_end FROM placed""")
def block_extents(spark, d):
    f = V.chunked(spark, d)
    return B.extents(B.block_table(f), f).select(*B.KEY, "logical_offset", "physical_offset", "physical_end")


@query("""SELECT r.archive_id, r.record_index, r.request, r."offset", p.logical_offset, p.physical_offset FROM requests r ASOF JOIN placed p ON r.record_index = p.record_index AND r."offset" >= p.logical_offset""")
def block_predecessor(spark, d):
    return B.predecessor(B.block_table(V.chunked(spark, d)), V.requests(spark, d).drop("n"))


@query("""SELECT r.archive_id, r.record_index, r.request, r."offset", p.logical_offset, p.physical_offset FROM requests r ASOF JOIN placed p ON r.record_index = p.record_index AND r."offset" < p.logical_offset""")
def block_successor(spark, d):
    return B.successor(B.block_table(V.chunked(spark, d)), V.requests(spark, d).drop("n"))


@query("""SELECT r.request, p.record_index, p.logical_offset, greatest(s, p.logical_offset) - p.logical_offset AS from_byte, least(e, p.logical_offset + 1024, p.decompressed_length) - p.logical_offset AS to_byte
FROM (SELECT q.request, q.record_index, least(q."offset", c.decompressed_length) AS s, least(q."offset" + q.n, c.decompressed_length) AS e FROM requests q JOIN chunked c ON q.record_index = c.record_index) r
JOIN placed p ON p.record_index = r.record_index AND p.logical_offset < r.e AND least(p.logical_offset + 1024, p.decompressed_length) > r.s WHERE r.s < r.e""")
def blocks_intersecting_range(spark, d):
    f = V.chunked(spark, d)
    return B.intersecting(B.block_table(f), B.clamp(V.requests(spark, d), f)).select("request", "record_index", "logical_offset", "from_byte", "to_byte")


def _damaged(spark, d):
    b = B.block_table(V.chunked(spark, d))
    b = b.where(~((F.col("record_index") % 50 == 1) & (F.col("logical_offset") == 1024)))
    return b.withColumn("physical_offset", F.when((F.col("record_index") % 40 == 3) & (F.col("logical_offset") == 2048), 0).otherwise(F.col("physical_offset")))


@query("""SELECT archive_id, record_index, logical_offset, fault FROM (SELECT *, CASE
 WHEN prev IS NULL AND logical_offset <> 0 THEN 'first block not at 0' WHEN prev IS NULL AND physical_offset <> data_offset THEN 'first block not at the data offset'
 WHEN logical_offset - prev <> 1024 THEN 'step is not the block size' WHEN physical_offset <= prev_physical THEN 'physical offset does not rise'
 WHEN nxt IS NULL AND logical_offset <> (decompressed_length - 1) // 1024 * 1024 THEN 'last block missing' END AS fault
 FROM (SELECT *, lag(logical_offset) OVER w AS prev, lag(physical_offset) OVER w AS prev_physical, lead(logical_offset) OVER w AS nxt
  FROM (SELECT * REPLACE (CASE WHEN record_index % 40 = 3 AND logical_offset = 2048 THEN 0 ELSE physical_offset END AS physical_offset) FROM placed WHERE NOT (record_index % 50 = 1 AND logical_offset = 1024))
  WINDOW w AS (PARTITION BY record_index ORDER BY logical_offset))) WHERE fault IS NOT NULL""")
def block_sequence_violations(spark, d):
    return B.sequence_faults(_damaged(spark, d), V.chunked(spark, d))


@query("""SELECT record_index, logical_offset, fault FROM (SELECT *, CASE WHEN physical_offset < data_offset OR physical_offset >= data_offset + length THEN 'outside the payload' END AS fault
 FROM (SELECT * REPLACE (CASE WHEN record_index % 40 = 3 AND logical_offset = 2048 THEN 0 ELSE physical_offset END AS physical_offset) FROM placed)) WHERE fault IS NOT NULL""")
def block_index_conflicts(spark, d):
    b = B.block_table(V.chunked(spark, d)).withColumn("physical_offset", F.when((F.col("record_index") % 40 == 3) & (F.col("logical_offset") == 2048), 0).otherwise(F.col("physical_offset")))
    return L.block_conflicts(b, V.chunked(spark, d)).select("record_index", "logical_offset", "fault")


@query("""SELECT r.request, p.record_index, p.logical_offset, p.physical_offset FROM requests r JOIN placed p ON p.record_index = r.record_index AND p.logical_offset = r.request % 4 * 1024""")
def block_by_number(spark, d):
    asked = V.requests(spark, d).select(*B.KEY, "request", (F.col("request") % 4).alias("number"))
    return B.block_by_number(B.block_table(V.chunked(spark, d)), asked).select("request", "record_index", "logical_offset", "physical_offset")


@query("SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS record_index FROM entries")
def record_numbering(spark, d):
    return V.records(spark, d).select("path", "record_index")


@query("""SELECT doc_id, length, CAST(32 + sum(length + (8 - length % 8) % 8) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (length + (8 - length % 8) % 8) AS BIGINT) AS data_offset FROM files""")
def layout_offsets(spark, d):
    return V.laid_out(spark, d).select("doc_id", "length", "data_offset")


@query("SELECT CAST(32 + sum(length + (8 - length % 8) % 8) AS BIGINT) AS trailer_offset FROM files")
def layout_trailer(spark, d):
    return L.trailer_offset(V.files(spark, d), 8)


@query("SELECT archive_id, greatest(32, max(data_offset + length)) AS cursor FROM chunked GROUP BY archive_id")
def append_cursor(spark, d):
    return L.append_cursor(V.chunked(spark, d))


@query("""SELECT archive_id, record_index, logical_offset, CAST(data_offset + coalesce(sum(least(1024, decompressed_length - logical_offset) // 2 + 7) OVER (PARTITION BY record_index ORDER BY logical_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS physical_offset FROM placed""")
def compressed_block_offsets(spark, d):
    size = F.least(F.lit(1024), F.col("decompressed_length") - F.col("logical_offset"))
    b = B.block_table(V.chunked(spark, d)).drop("physical_offset").withColumn("compressed", F.floor(size / 2) + 7)
    return L.block_offsets(b).select(*B.KEY, "logical_offset", "physical_offset")


@query("""SELECT 'path' AS kind, path AS key, count(DISTINCT doc_id % 400) AS n FROM (SELECT doc_id, concat_ws(chr(31), 'corpus', lang, 'doc_' || (doc_id % 300) || '.txt') AS path FROM files) GROUP BY path HAVING count(DISTINCT doc_id % 400) > 1
UNION ALL SELECT 'record', CAST(doc_id % 400 AS VARCHAR), count(DISTINCT path) FROM (SELECT doc_id, concat_ws(chr(31), 'corpus', lang, 'doc_' || (doc_id % 300) || '.txt') AS path FROM files) GROUP BY doc_id % 400 HAVING count(DISTINCT path) > 1""")
def path_index_conflicts(spark, d):
    f = V.files(spark, d)
    return L.path_conflicts(f.select(S.join_path("corpus", F.col("lang"), F.concat(F.lit("doc_"), F.col("doc_id") % 300, F.lit(".txt"))).alias("path"), (F.col("doc_id") % 400).alias("record_index")))


@query("SELECT path, max(position) AS record_index FROM site GROUP BY path")
def index_upsert(spark, d):
    return L.upserted(V.site(spark, d).select("path", F.col("position").alias("record_index"), "position"), "position")


@query("""SELECT path, position, CASE WHEN path = prev THEN 'duplicate' ELSE 'out of order' END AS fault FROM (SELECT path, position, lag(path) OVER (ORDER BY position) AS prev FROM site) WHERE path <= prev""")
def index_insert_faults(spark, d):
    return L.index_faults(V.site(spark, d).select("path", "position"), "position")


@query("SELECT path FROM files WHERE doc_id % 3 = 0 AND array_to_string(string_split(path, chr(31))[:-2], chr(31)) NOT IN (SELECT path FROM dirs WHERE path NOT LIKE '%src1')")
def missing_parents(spark, d):
    e = V.entries(spark, d).where("record_type = 'directory' AND path NOT LIKE '%src1' OR doc_id % 3 = 0")
    return L.missing_parents(e.select("path", "record_type")).where("record_type <> 'directory'").select("path")


@query("SELECT path FROM dirs WHERE path NOT LIKE '%src1'")
def directories_to_make(spark, d):
    have = V.entries(spark, d).where("record_type = 'directory' AND path LIKE '%src1'")
    return L.directories_to_make(V.files(spark, d), have)


def _attrs(spark, d):
    """An attribute table made of orders: a key, a declared type, raw bytes."""
    o = V.table(spark, d, "orders")
    raw = F.encode(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"p":"'), F.col("o_orderpriority"), F.lit('"}'))).otherwise(F.col("o_orderpriority")), "UTF-8")
    return o.select(
        F.lit(0).cast("long").alias("archive_id"),
        F.col("o_orderkey").alias("record_index"),
        F.pmod(F.col("o_custkey"), F.lit(5)).cast("int").alias("key_index"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(5)) == 2, F.encode(F.col("o_orderstatus"), "UTF-8")).otherwise(raw).alias("raw"),
    )


def _keys(spark):
    rows = [(0, 0, "title", "string"), (0, 1, "meta", "json"), (0, 2, "flag", "u8"), (0, 3, "sum", "u256")]
    return spark.createDataFrame(rows, "archive_id long, key_index int, name string, attr_type string")


@query("""SELECT record_index, key, declared_type, CASE WHEN declared_type = 'json' AND json_valid(s) THEN 'json' WHEN declared_type = 'json' THEN 'string' WHEN declared_type = 'u256' THEN 'bytes' ELSE declared_type END AS effective_type,
 CASE WHEN declared_type IN ('string', 'json') THEN s END AS v_string, CASE WHEN declared_type = 'u8' THEN CAST(ascii(s) AS BIGINT) END AS v_long
FROM (SELECT o_orderkey AS record_index, ['title', 'meta', 'flag', 'sum'][CAST(o_custkey % 5 AS INT) + 1] AS key, ['string', 'json', 'u8', 'u256'][CAST(o_custkey % 5 AS INT) + 1] AS declared_type,
 CASE WHEN o_custkey % 5 = 2 THEN o_orderstatus WHEN o_orderkey % 4 = 0 THEN '{"p":"' || o_orderpriority || '"}' ELSE o_orderpriority END AS s FROM orders WHERE o_custkey % 5 < 4)""")
def attr_long_to_typed(spark, d):
    return A.typed(A.named(_attrs(spark, d), _keys(spark))).select("record_index", "key", "declared_type", "effective_type", "v_string", "v_long")


def _modes(spark, d):
    f = V.files(spark, d)
    own = f.where("doc_id % 3 = 0").select("archive_id", (F.col("doc_id") + 1).alias("record_index"), F.lit("unix.mode").alias("key"), (F.lit(0o100600) + F.col("doc_id") % 64).cast("long").alias("v_long"))
    return own


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(33152 + doc_id % 64 AS BIGINT) ELSE CAST(33188 AS BIGINT) END AS mode FROM files""")
def attr_defaults(spark, d):
    f = V.files(spark, d).withColumn("record_index", F.col("doc_id") + 1)
    return A.modes(f, _modes(spark, d)).select("doc_id", F.col("`unix.mode`").alias("mode"))


@query("""SELECT o_orderkey AS record_index, coalesce(m, c, to_timestamp(0)::TIMESTAMP) AS mtime, coalesce(a, m, c, to_timestamp(0)::TIMESTAMP) AS atime, coalesce(c, to_timestamp(0)::TIMESTAMP) AS crtime
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 DAY END AS m, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 2 DAY END AS a FROM orders)""")
def timestamp_fallbacks(spark, d):
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    when = F.col("o_orderdate").cast("timestamp")
    wide = o.select(
        k.alias("record_index"), F.when(k % 2 == 0, when).alias("created"), F.when(k % 3 == 0, when + F.expr("INTERVAL 1 DAY")).alias("modified"), F.when(k % 5 == 0, when + F.expr("INTERVAL 2 DAY")).alias("accessed")
    )
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return A.timestamps(wide).select("record_index", ntz("mtime"), ntz("atime"), ntz("crtime"))


@query("""SELECT c_custkey AS record_index, CASE WHEN c_nationkey <> (SELECT arg_min(c_nationkey, c_custkey) FROM customer) THEN CAST(c_nationkey AS BIGINT) END AS uid FROM customer""")
def owner_factoring(spark, d):
    c = V.table(spark, d, "customer").select(F.lit(0).cast("long").alias("archive_id"), F.col("c_custkey").alias("record_index"), F.col("c_nationkey").cast("long").alias("uid"))
    return A.factored(c, "uid", "record_index")[1].select("record_index", "uid")


ACL = " || ".join(f"CASE WHEN (m & {1 << (8 - k)}) <> 0 THEN '{'rwx'[k % 3]}' ELSE '-' END" for k in range(9))


@query(f"SELECT p_partkey, m AS mode, {ACL} AS acl FROM (SELECT p_partkey, CAST((p_partkey * 37 + p_size) % 512 AS BIGINT) AS m FROM part)")
def mode_string(spark, d):
    mode = (F.col("p_partkey") * 37 + F.col("p_size")) % 512
    return V.table(spark, d, "part").select("p_partkey", mode.alias("mode"), S.format_acl(mode).alias("acl"))


@query("SELECT o_orderkey, strftime(to_timestamp(1767225600 + (o_orderkey - 5000) * 60 + o_custkey % 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS shown FROM orders")
def minutes_as_time(spark, d):
    ts = S.minutes_to_timestamp(F.col("o_orderkey") - 5000, F.col("o_custkey") % 60)
    return V.table(spark, d, "orders").select("o_orderkey", S.format_time(ts).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, a, o, CASE WHEN a = 0 THEN o ELSE (o + a - 1) // a * a END AS aligned FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 5 * 8 AS BIGINT) AS a, l_partkey AS o FROM lineitem)")
def aligned_values(spark, d):
    a, o = F.col("l_suppkey") % 5 * 8, F.col("l_partkey")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), o.alias("o"), S.align_up(o, a).alias("aligned"))


@query("SELECT path, archive_id, is_dir, record_index FROM merged")
def merge_namespace(spark, d):
    return N.merged(V.overlay(spark, d)).select("path", "archive_id", "is_dir", "record_index")


@query("SELECT 'corpus' || chr(31) || lang AS directory, path, string_split(path, chr(31))[-1] AS name, archive_id FROM (SELECT *, string_split(path, chr(31))[2] AS lang FROM merged)")
def merged_children(spark, d):
    o = V.overlay(spark, d)
    dirs = o.select(F.substring_index("path", S.SEP, 2).alias("path")).distinct()
    return N.merged_children(o, dirs).select("directory", "path", "name", "archive_id")


@query("SELECT count(*) AS records, CAST(sum(decompressed_length) AS BIGINT) AS bytes FROM overlay")
def merged_totals(spark, d):
    return N.merged_totals(V.overlay(spark, d))


@query("SELECT archive_id, record_index, CAST(CAST(archive_id AS HUGEINT) * 18446744073709551616 + record_index AS VARCHAR) AS composite_key, archive_id * 281474976710656 + record_index + 1 AS inode FROM overlay")
def composite_keys(spark, d):
    a, r = F.col("archive_id"), F.col("record_index")
    return V.overlay(spark, d).select(a, r, S.composite(a, r).cast("string").alias("composite_key"), S.inode(a, r).alias("inode"))


@query("SELECT l.path, l.link_target_index, f.path AS target_path FROM links l LEFT JOIN files f ON l.link_target_index = f.doc_id + 1")
def resolve_links(spark, d):
    t = V.files(spark, d).withColumn("record_index", F.col("doc_id") + 1)
    return N.resolve_links(V.links(spark, d), t).select("path", "link_target_index", "target_path")


@query("SELECT path, link_target_index FROM links WHERE link_target_index NOT IN (SELECT doc_id + 1 FROM files)")
def dangling_links(spark, d):
    t = V.files(spark, d).withColumn("record_index", F.col("doc_id") + 1)
    return N.dangling(V.links(spark, d), t).select("path", "link_target_index")


@query("SELECT l.path, '../../' || array_to_string(string_split(f.path, chr(31))[2:], '/') AS relative FROM links l JOIN files f ON l.link_target_index = f.doc_id + 1")
def relative_link_target(spark, d):
    t = V.files(spark, d).withColumn("record_index", F.col("doc_id") + 1)
    found = N.resolve_links(V.links(spark, d), t).where("target_path IS NOT NULL")
    return found.select("path", N.relative_target(F.col("path"), F.col("target_path")).alias("relative"))


@query("""SELECT l.path, CAST(strlen(string_split(f.path, chr(31))[-1]) AS BIGINT) AS size_by_name, CAST(strlen('../../' || array_to_string(string_split(f.path, chr(31))[2:], '/')) AS BIGINT) AS size_by_path
FROM links l JOIN files f ON l.link_target_index = f.doc_id + 1""")
def link_sizes(spark, d):
    t = V.files(spark, d).withColumn("record_index", F.col("doc_id") + 1)
    found = N.resolve_links(V.links(spark, d), t).where("target_path IS NOT NULL")
    target = F.col("target_path")
    sizes = N.reported_size(F.lit("link"), F.lit(0).cast("long"), S.name(target), N.relative_target(F.col("path"), target), F.lit(None).cast("string"))
    return found.select("path", *[c.alias(k) for k, c in sizes.items()])


@query("""SELECT archive_id, count(*) AS files_checked, count(*) FILTER (expected IS NULL) AS files_without_checksum, count(*) FILTER (expected <> actual) AS checksum_failures
FROM (SELECT archive_id, sha256(text) AS actual, CASE WHEN doc_id % 4 <> 0 THEN sha256(text || CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END) END AS expected FROM files) GROUP BY archive_id""")
def validate_counts(spark, d):
    f, i = V.files(spark, d, text=True), F.col("doc_id")
    expected = F.when(i % 4 != 0, F.sha2(F.concat("text", F.when(i % 9 == 0, "x").otherwise("")), 256))
    return M.validation(f.select("archive_id", expected.alias("expected"), F.sha2("text", 256).alias("actual")))


def _block_bytes(spark, d):
    f = V.files(spark, d, text=True).where("record_type = 'chunked_file'").withColumn("record_index", F.col("doc_id") + 1)
    starts = F.sequence(F.lit(0).cast("long"), F.col("decompressed_length") - 1, F.lit(1024).cast("long"))
    out = f.select(*B.KEY, F.encode("text", "UTF-8").alias("_all"), F.explode(starts).alias("logical_offset"))
    return out.select(*B.KEY, "logical_offset", F.expr("substring(_all, CAST(logical_offset + 1 AS INT), 1024)").alias("content"))


@query("""SELECT q.request, q.record_index, substr(hex(encode(c.text)), 2 * q."offset" + 1, 2 * least(q.n, c.decompressed_length - q."offset")) AS bytes FROM requests q JOIN chunked c ON q.record_index = c.record_index WHERE q."offset" < c.decompressed_length""")
def range_read_bytes(spark, d):
    f = V.chunked(spark, d)
    parts = B.intersecting(B.block_table(f), B.clamp(V.requests(spark, d), f))
    return B.range_bytes(parts, _block_bytes(spark, d), ["request", "record_index"]).select("request", "record_index", F.hex("content").alias("bytes"))


@query("SELECT record_index, sha256(text) AS digest FROM chunked")
def reassemble_blocks(spark, d):
    return B.reassemble(_block_bytes(spark, d)).select("record_index", F.sha2("content", 256).alias("digest"))


@query("SELECT archive_id, samples, bytes, bytes >= 3276800 AS enough FROM (SELECT archive_id, count(*) AS samples, CAST(sum(least(decompressed_length, 4096)) AS BIGINT) AS bytes FROM files WHERE decompressed_length > 0 GROUP BY archive_id)")
def dictionary_samples(spark, d):
    c = V.files(spark, d, text=True).select("archive_id", F.encode("text", "UTF-8").alias("content"))
    return M.dictionary_gate(M.dictionary_samples(c))


def _reads(spark, d):
    f = V.files(spark, d).select((F.col("doc_id") + 1).alias("record_index"), "path")
    r = V.requests(spark, d).join(f, "record_index")
    return r.select("path", (F.col("n") % 3 == 0).alias("hit"), (F.col("n") * 11 + F.col("offset")).alias("nanos"))


READS = """(SELECT f.path, count(*) AS reads, count(*) FILTER (q.n % 3 = 0) AS hits, CAST(sum(q.n * 11 + q."offset") AS BIGINT) AS nanos FROM requests q JOIN files f ON q.record_index = f.doc_id + 1 GROUP BY f.path)"""


@query(f"SELECT * FROM {READS}")
def read_counters(spark, d):
    return M.read_counters(_reads(spark, d))


@query(f"SELECT * FROM {READS} ORDER BY nanos DESC, path LIMIT 10")
def top_paths(spark, d):
    return M.costliest(M.read_counters(_reads(spark, d)), 10)


@query("SELECT path, record_type FROM entries ORDER BY path LIMIT 40 OFFSET 60")
def paged_listing(spark, d):
    return E.page(V.entries(spark, d).select("path", "record_type"), ["path"], 60, 40)


@query("SELECT (CAST(sum(decompressed_length) AS BIGINT) + 4095) // 4096 AS blocks_of_content, (CAST(sum(length + 100) AS BIGINT)) // 4096 AS blocks_of_archive FROM files")
def statfs(spark, d):
    return M.statfs(V.files(spark, d).select(F.col("decompressed_length").alias("size"), (F.col("length") + 100).alias("file_size")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (mask & 2) <> 0 THEN false WHEN usr = 0 THEN true ELSE (CASE WHEN usr = uid THEN (mode >> 6) & 7 WHEN grp = gid THEN (mode >> 3) & 7 ELSE mode & 7 END & mask) = mask END AS permitted
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 31 % 512 AS mode, l_suppkey % 4 AS uid, l_suppkey % 3 AS gid, CAST(l_linenumber AS BIGINT) % 8 AS mask, l_orderkey % 4 AS usr, l_orderkey % 3 AS grp FROM lineitem)""")
def access_check(spark, d):
    c = F.col
    ok = M.permitted(c("l_partkey") * 31 % 512, c("l_suppkey") % 4, c("l_suppkey") % 3, c("l_linenumber").cast("long") % 8, c("l_orderkey") % 4, c("l_orderkey") % 3)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("permitted"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'S_A_L%'")
def wildcard_names(spark, d):
    return V.table(spark, d, "part").where(E.wildcard(F.col("p_name"), "S?A?L*")).select("p_partkey", "p_name")


@query("SELECT count(*) AS paths, avg(depth + 1) AS avg_depth, CAST(max(depth + 1) AS BIGINT) AS max_depth, avg(strlen(path)) AS avg_length FROM parts")
def path_statistics(spark, d):
    return M.path_statistics(V.entries(spark, d))


@query("SELECT min(path) AS path, doc_id % 400 AS record_index FROM files GROUP BY doc_id % 400")
def path_for_record(spark, d):
    return E.path_of_record(V.files(spark, d).select("path", (F.col("doc_id") % 400).alias("record_index")))


@query("SELECT hex(x) AS key, record_index, logical_offset FROM (SELECT record_index, logical_offset, unhex(lpad(hex(record_index), 16, '0') || lpad(hex(logical_offset), 16, '0')) AS x FROM placed)")
def block_keys(spark, d):
    b = B.block_table(V.chunked(spark, d))
    return b.select(F.hex(S.block_key(F.col("record_index"), F.col("logical_offset"))).alias("key"), "record_index", "logical_offset")


@query("SELECT c_custkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f', n / 1024.0::DOUBLE) || ' KiB' WHEN n < 1073741824 THEN printf('%.2f', n / 1048576.0::DOUBLE) || ' MiB' ELSE printf('%.2f', n / 1073741824.0::DOUBLE) || ' GiB' END AS shown FROM (SELECT c_custkey, CAST(c_custkey * c_custkey * 64 AS BIGINT) AS n FROM customer)")
def size_text(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.format_size(F.col("c_custkey") * F.col("c_custkey") * 64).alias("shown"))


@query("SELECT path FROM files WHERE doc_id % 2 = 0 AND path NOT IN (SELECT path FROM files WHERE doc_id % 6 = 0)")
def candidate_difference(spark, d):
    f = V.files(spark, d)
    return f.where("doc_id % 2 = 0").join(f.where("doc_id % 6 = 0"), "path", "left_anti").select("path")


@query(None)
def lru_simulation(spark, d):
    """Stateful; checked against a replay in plain Python."""
    r = V.requests(spark, d).select("archive_id", F.col("request").alias("at"), F.col("record_index").alias("block"), F.col("n").alias("size"))
    return M.lru_hits(r, 1 << 18)


@query("""SELECT path, CASE WHEN record_type = 'directory' THEN '{"path":"' || replace(path, chr(31), '/') || '","type":"directory"}'
 ELSE '{"path":"' || replace(path, chr(31), '/') || '","type":"' || record_type || '","compression":"' || compression || '","decompressed_length":' || decompressed_length || '}' END AS json FROM entries""")
def listing_json(spark, d):
    return M.listing_json(V.entries(spark, d))


def _xattrs(spark, d):
    e = V.table(spark, d, "events")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("linux.xattr.user."), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("record_index"), key.alias("key"), F.encode("event_type", "UTF-8").alias("raw"))


@query("SELECT event_id AS record_index, 'user.' || event_type AS xattr, hex(encode(event_type)) AS raw FROM events WHERE event_id % 3 = 0")
def xattr_projection(spark, d):
    return A.xattrs(_xattrs(spark, d)).select("record_index", "xattr", F.hex("raw").alias("raw"))


@query("SELECT path, CASE WHEN mode <> CASE WHEN record_type = 'directory' THEN 16877 ELSE 33188 END THEN mode END AS mode FROM (SELECT path, record_type, CAST(CASE WHEN strlen(path) % 3 = 0 THEN 33188 WHEN strlen(path) % 3 = 1 THEN 16877 ELSE 33152 END AS BIGINT) AS mode FROM entries)")
def omitted_modes(spark, d):
    n = F.octet_length("path") % 3
    e = V.entries(spark, d).withColumn("mode", F.when(n == 0, 0o100644).when(n == 1, 0o40755).otherwise(0o100600).cast("long"))
    return A.omit_default_mode(e).select("path", "mode")


@query("SELECT path, name, row_number() OVER (ORDER BY lower(name), path) AS place FROM parts")
def names_without_case(spark, d):
    return E.sorted_by_name(V.entries(spark, d).select("path")).select("path", "name", "place")


@query("""SELECT id, fault FROM (SELECT 1000 + s_suppkey AS id, 'repeated' AS fault FROM supplier WHERE s_suppkey % 9 = 2
UNION ALL SELECT 1000 + s_suppkey, 'unreachable' FROM supplier WHERE s_suppkey % 7 = 3)""")
def tree_faults(spark, d):
    nodes = _tree(spark, d)
    supplier = (F.col("id") > 1000) & ((F.col("id") - 1000) % 7 == 3)
    broken = nodes.withColumn("parent_id", F.when(supplier, F.col("id")).otherwise(F.col("parent_id")))
    twice = broken.where((F.col("id") > 1000) & ((F.col("id") - 1000) % 9 == 2))
    return E.tree_faults(broken.unionByName(twice), E.tree_paths(broken))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN 'escapes' ELSE 'external_symlinks' END AS reason FROM region WHERE r_regionkey % 2 = 1 OR r_regionkey = 4")
def extraction_gates(spark, d):
    r = V.table(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") % 2 == 1).alias("allow_escapes"), (F.col("r_regionkey") == 4).alias("allow_external_symlinks"))
    return E.extraction_gate(r).select("r_regionkey", "reason")


@query("SELECT path, 'doc_' || (doc_id % 100) || '.txt' AS record_name FROM files WHERE doc_id >= 100")
def name_mismatches(spark, d):
    return E.name_faults(V.files(spark, d).select("path", F.concat(F.lit("doc_"), F.col("doc_id") % 100, F.lit(".txt")).alias("record_name")))


@query("SELECT doc_id % 400 AS record_index, count(*) AS n FROM files GROUP BY doc_id % 400 HAVING count(*) > 1")
def aliased_records(spark, d):
    return E.alias_faults(V.files(spark, d).select((F.col("doc_id") % 400).alias("record_index")))


@query("SELECT path, CASE WHEN position % 5 = 0 THEN 'directory' WHEN position % 5 = 1 THEN 'symlink' ELSE 'file' END AS kind FROM site")
def classified_entries(spark, d):
    p = F.col("position") % 5
    return E.classify(V.site(spark, d).select("path", (p == 0).alias("is_dir"), (p == 1).alias("is_symlink"))).select("path", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n, hex(encode(o_orderstatus)) AS mode FROM orders")
def attribute_upsert(spark, d):
    o = V.table(spark, d, "orders")
    raw = F.encode("o_orderstatus", "UTF-8")
    attrs = F.create_map(F.when(F.col("o_orderkey") % 2 == 0, "unix.mode").otherwise("title"), F.encode(F.lit("old"), "UTF-8"))
    done = A.upsert_attr(o.select("o_orderkey", "o_orderstatus", attrs.alias("attrs")), "unix.mode", raw)
    return done.select("o_orderkey", F.size("attrs").alias("n"), F.hex(F.col("attrs")["unix.mode"]).alias("mode"))


@query("SELECT l.path, l.target_path, CASE WHEN f.path IS NULL THEN 'external_link' ELSE 'link' END AS record_type FROM (SELECT path, CASE WHEN link_target_index % 4 = 0 THEN '/etc/x' || link_target_index ELSE concat_ws(chr(31), 'corpus', 'n' || link_target_index) END AS target_path FROM links) l LEFT JOIN (SELECT concat_ws(chr(31), 'corpus', 'n' || (doc_id + 1)) AS path FROM files) f ON l.target_path = f.path")
def captured_symlinks(spark, d):
    t = F.col("link_target_index")
    l = V.links(spark, d).select("path", F.when(t % 4 == 0, F.concat(F.lit("/etc/x"), t)).otherwise(S.join_path("corpus", F.concat(F.lit("n"), t))).alias("target_path"))
    a = V.files(spark, d).select(S.join_path("corpus", F.concat(F.lit("n"), F.col("doc_id") + 1)).alias("path"), (F.col("doc_id") + 1).alias("record_index"))
    return N.capture_symlinks(l, a, allow_external=True).select("path", "target_path", "record_type")


@query("""SELECT path, CASE WHEN doc_id % 3 = 0 THEN doc_id + 100000 ELSE doc_id END AS record_index FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def appended_index(spark, d):
    f = V.files(spark, d)
    old = f.where("doc_id % 2 = 0").select("path", F.col("doc_id").alias("record_index"))
    new = f.where("doc_id % 3 = 0").select("path", (F.col("doc_id") + 100000).alias("record_index"))
    return L.merged_index(old, new)


@query("SELECT count(*) AS files, CAST(sum(decompressed_length) AS BIGINT) AS bytes, CAST(count(*) FILTER (record_type = 'chunked_file') AS BIGINT) AS chunked FROM files")
def run_statistics(spark, d):
    runs = V.files(spark, d).groupBy("source").agg(F.count("*").alias("files"), F.sum("decompressed_length").alias("bytes"), F.count_if(F.col("record_type") == "chunked_file").alias("chunked")).drop("source")
    return M.add_stats(runs)


@query("SELECT i, i // 281474976710656 AS archive_id, i % 281474976710656 AS record_index FROM (SELECT archive_id * 281474976710656 + record_index AS i FROM overlay)")
def inode_parts(spark, d):
    i = S.inode(F.col("archive_id"), F.col("record_index"))
    return V.overlay(spark, d).select((i - 1).alias("i"), S.inode_archive(i).alias("archive_id"), S.inode_record(i).alias("record_index"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'blake3:' || sha256(path) ELSE 'crc32:' || substr(hex(encode(path)), 7, 2) || substr(hex(encode(path)), 5, 2) || substr(hex(encode(path)), 3, 2) || substr(hex(encode(path)), 1, 2) END AS shown FROM files""")
def checksum_texts(spark, d):
    strong = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.sha2("path", 256)))
    out = S.checksum_text(strong, F.encode("path", "UTF-8"))
    return V.files(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, out).otherwise(F.concat(F.lit("crc32:"), F.upper(F.substring(out, 7, 8)))).alias("shown"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0o' || printf('%o', CAST(p_size AS BIGINT)) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_name ELSE lower(hex(encode(p_name))) END AS shown FROM part")
def attribute_texts(spark, d):
    k = F.col("p_partkey") % 4
    size = F.when(k < 2, F.col("p_size").cast("long"))
    shown = S.attr_display(F.when(k == 0, "unix.mode").otherwise("other"), F.lit("vu32"), size, F.when(k == 2, F.col("p_name")), F.encode("p_name", "UTF-8"))
    return V.table(spark, d, "part").select("p_partkey", shown.alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, b, CASE b & 15 WHEN 1 THEN 'directory' WHEN 2 THEN 'file' WHEN 3 THEN 'link' WHEN 10 THEN 'chunked_file' WHEN 11 THEN 'external_link' END AS kind,
 CASE b & 240 WHEN 0 THEN 'stored' WHEN 16 THEN 'zstd' WHEN 32 THEN 'xz' ELSE '?' || lower(hex(b & 240)) || '?' END AS codec FROM (SELECT l_orderkey, l_linenumber, l_partkey % 64 AS b FROM lineitem)""")
def type_bytes(spark, d):
    b = F.col("l_partkey") % 64
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b"), S.record_kind(b).alias("kind"), S.record_codec(b).alias("codec"))


@query("SELECT record_index, logical_offset, 4096 + physical_offset AS at FROM placed")
def data_locations(spark, d):
    b = B.block_table(V.chunked(spark, d))
    return b.select("record_index", "logical_offset", S.data_location(F.lit(4096).cast("long"), F.col("physical_offset")).alias("at"))


def _integer_sql() -> str:
    byte = lambda v: f"lpad(hex(CAST(({v}) & 255 AS BIGINT)), 2, '0')"
    cases = []
    for n, start in enumerate(S.BIAS):
        head = byte(f"((x - {start}) >> {8 * n}) | {0x80 >> n}") if n < 8 else "'00'"
        cases.append(f"WHEN x >= {start} " + (f"AND x < {S.BIAS[n + 1]} " if n < 8 else "") + "THEN " + " || ".join([head, *(byte(f"(x - {start}) >> {8 * k}") for k in range(n))]))
    return "CASE " + " ".join(cases) + " END"


@query(f"""SELECT l_orderkey, l_linenumber, {_integer_sql()} AS raw, x AS back FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey % 300 ELSE (l_partkey * 7919) << CAST(6 * (l_linenumber - 2) AS INT) END AS x FROM lineitem)""")
def integer_encoding(spark, d):
    """Integers of every length, as bytes and back, in built-in functions."""
    x = F.when(F.col("l_linenumber") == 1, F.col("l_partkey") % 300).otherwise(F.expr("shiftleft(l_partkey * 7919, CAST(6 * (l_linenumber - 2) AS INT))"))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.vu64_encode(x).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", F.hex("raw").alias("raw"), S.vu64_decode(F.col("raw")).cast("long").alias("back"))


@query("SELECT path, sha256(text) AS zstd, sha256(text) AS xz FROM files")
def codec_round_trip(spark, d):
    from .functions import udfs as U

    f = V.files(spark, d, text=True).select("path", F.encode("text", "UTF-8").alias("b"))
    return f.select("path", F.sha2(U.zstd_decompress(U.zstd_compress("b")), 256).alias("zstd"), F.sha2(U.xz_decompress(U.xz_compress("b")), 256).alias("xz"))


@query("SELECT position, path FROM site")
def normalized_paths(spark, d):
    from .functions.udfs import path_normalize

    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/./"), "[?#].*$", "")
    return V.table(spark, d, "pages").select(F.col("page_id").alias("position"), path_normalize(bare).alias("path"))


@query(None)
def blake3_digests(spark, d):
    """BLAKE3 has no SQL form here; published vectors are in the tests."""
    from .functions.udfs import blake3_256

    return V.files(spark, d, text=True).select("path", F.hex(blake3_256(F.encode("text", "UTF-8"))).alias("digest"))


_register_real(query)
