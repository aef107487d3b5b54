"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted
on a bounded sample of labelled texts (lower-cased).  A byte's code length
follows the tree from the longest context that occurred: the byte's share
there, or the escape share and then the next shorter context without the
symbols already excluded (escape method C with exclusion), down to equal
shares of the bytes never seen.  The statistics are frozen, so the length of
a byte in a context is a constant; all of them are put in one table
(contexts x symbols x languages) and a text's code length under each language
is a sum of table rows.  Bytes that occur in no sample behave alike and share
one symbol, which loses nothing.

The prediction is the language of least code length (ties: the first by code
point).  ``score`` is that language's share when each language counts as
2 ** -(bits per byte * min(bytes, 64)).

``recognised`` says whether the text's code length is what that language's
texts need: each half of the sample is coded with the other half's tables, and
a text of n bytes may need ``MARGIN`` times n times the most bits a byte that a
text of ``LONG`` bytes or more needed so, and ``GRACE`` bits more.  A text in a
language never learned is not recognised, however sure the nearest one is.

Training never sees the held-out fold.  The sample is bounded by ``ROWS``
texts and ``BYTES`` a language, those of least id hash, so what a language adds
to driver, model and broadcast has a fixed size (the table grows with the
number of languages, of which there are few); scoring reads every byte of every
text, however long.

Edge cases: a null text, or one without a letter, gives ``und`` and score 0
and isn't recognised, as does everything when nothing can be learned; null ids
are scored and never learned from; repeated rows get equal answers; languages
of equal code length are settled by code point; all columns are kept, and the
new ones' names lengthened where the table has them; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fold, fresh, held_out, in_front, read
from .kernels import blocks, text_bytes

ORDER = 3
ROWS, BYTES = 300, 4 << 20
MARGIN, GRACE, LONG = 1.25, 256, 256
FOLDS, HELD_OUT = 4, 2
SCALE_BYTES = 64


class Model:
    """langs, the symbol of each byte, the context of each symbol triple, and code lengths."""

    def __init__(self, texts: dict[str, list[str]], checked: bool = True):
        """checked: also find the most bits a byte that each language's texts need."""
        self.langs = sorted(texts)
        coded = {k: [t.lower().encode() for t in v] for k, v in texts.items()}
        seen = np.zeros(256, bool)
        for v in coded.values():
            for t in v:
                seen[np.frombuffer(t, np.uint8)] = True
        size = self.size = int(seen.sum()) + 1  # symbol 0: all other bytes
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, size)
        counts = {k: [self._count(v, k2) for k2 in range(ORDER + 1)] for k, v in coded.items()}
        # contexts of any language, by order; number 0 is the empty one
        keys = [np.unique(np.concatenate([counts[k][o][0] // size for k in self.langs])) if self.langs else np.zeros(0, np.int64) for o in range(ORDER + 1)]
        base = np.cumsum([0] + [len(x) for x in keys])
        self.context = np.zeros(size, np.int32)
        for o in range(1, ORDER + 1):
            table = np.tile(self.context, size) if o > 1 else np.zeros(size, np.int32)
            table[keys[o]] = base[o] + np.arange(len(keys[o]))
            self.context = table
        self.bits = np.zeros((int(base[-1]), size, len(self.langs)), np.float32)
        for i, lang in enumerate(self.langs):
            self._lengths(counts[lang], keys, base, i)
        self.most = np.full(len(self.langs), np.inf)
        if checked and self.langs:
            self._spread(texts)

    def _spread(self, texts: dict[str, list[str]]) -> None:
        for half in (0, 1):
            other = Model({k: v[1 - half :: 2] for k, v in texts.items()}, checked=False)
            for i, lang in enumerate(self.langs):
                raw = [t.lower().encode() for t in texts[lang][half::2]]
                raw = [t for t in raw if len(t) >= LONG]
                if raw and texts[lang][1 - half :: 2]:
                    data, offsets = text_bytes(pa.array(raw, pa.large_binary()))
                    worst = float((other.lengths(data, offsets)[:, i] / np.diff(offsets)).max())
                    self.most[i] = worst if np.isinf(self.most[i]) else max(self.most[i], worst)

    def _count(self, texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
        """The (context, symbol) codes of one order, and how often each occurs."""
        parts = [np.zeros(0, np.int64)]
        for t in texts:
            s = self.symbol[np.frombuffer(t, np.uint8)].astype(np.int64)
            if len(s) > order:
                code = np.zeros(len(s) - order, np.int64)
                for j in range(order + 1):
                    code = code * self.size + s[j : j + len(code)]
                parts.append(code)
        return np.unique(np.concatenate(parts), return_counts=True)

    def _lengths(self, counts: list, keys: list, base: np.ndarray, lang: int) -> None:
        size = self.size
        rest = 256 - (size - 1)
        never = np.zeros((1, size), np.float64)
        lower_cost = lower_escape = lower_n = None
        for o in range(ORDER + 1):
            n = np.zeros((len(keys[o]), size), np.int64)
            code, times = counts[o]
            if len(code):
                n[np.searchsorted(keys[o], code // size), code % size] = times
            known, total, kinds = n > 0, n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            if o == 0:
                if not len(keys[0]):
                    n, known, total, kinds = (np.zeros((1, size), np.int64), np.zeros((1, size), bool), *np.zeros((2, 1, 1), np.int64))
                # after an escape from order 0: equal shares of the bytes not seen
                after = never + np.log2(max(1, rest + int((~known[0, 1:]).sum())))
            else:
                up = self._shorter(keys[o], o, keys[o - 1])
                m = np.where(known, 0, lower_n[up])
                d = (m > 0).sum(1, keepdims=True)
                whole = m.sum(1, keepdims=True) + d
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = np.log2(whole) - np.log2(m)
                    # nothing left at the shorter context: passing it costs nothing
                    miss = np.where(d > 0, np.log2(whole) - np.log2(d), 0.0)
                after = np.where(m > 0, hit, miss + lower_escape[up])
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.log2(total + kinds) - np.log2(n)
                cost = np.where(known, share, np.log2(total + kinds) - np.log2(kinds) + after)
            if o:
                absent = total[:, 0] == 0  # a context of other languages only
                cost[absent] = lower_cost[up][absent]
                after[absent] = lower_escape[up][absent]
                n[absent] = lower_n[up][absent]
            else:
                cost = cost if total.sum() else after
            self.bits[base[o] : base[o + 1], :, lang] = cost
            lower_cost, lower_escape, lower_n = cost, after, n

    def _shorter(self, key: np.ndarray, order: int, shorter: np.ndarray) -> np.ndarray:
        """Which context of the order below a context ends in (it always occurs)."""
        return np.searchsorted(shorter, key % self.size ** (order - 1))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for first, part, at in blocks(data, offsets):
            s = self.symbol[part]
            size, n = self.size, len(s)
            code = np.zeros(n, np.int32)
            for back in range(ORDER, 0, -1):
                prior = np.zeros(n, np.int32)
                prior[back:] = s[:-back]
                # before a text there is nothing: symbol 0 occurs in no context
                for j in range(back):
                    edge = at[:-1] + j
                    prior[edge[edge < at[1:]]] = 0
                code = code * size + prior
            row = self.context[code].astype(np.int64) * size + s
            flat = self.bits.reshape(-1, len(self.langs))
            filled = at[:-1] < at[1:]
            for k in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(np.ascontiguousarray(flat[:, k])[row], dtype=np.float64)])
                out[first : first + len(at) - 1, k] = np.where(filled, run[at[1:]] - run[at[:-1]], 0.0)
        return out


def sample(docs: DataFrame, rows: int = ROWS) -> dict[str, list[str]]:
    """At most ``rows`` whole texts of each language outside the held-out fold, those of least id hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    many = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    # a row a language, of which the model holds a table each: without this, all ids would be dealt by language
    ids = ids.join(F.broadcast(many), "lang").where(in_front(F.col("h"), rows, F.col("n")))
    top = ids.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= rows).select("doc_id").distinct()
    # at most rows ids a language, so this side is small whatever the table's size
    some = known.select("doc_id", "lang", "text").join(F.broadcast(top), "doc_id", "left_semi")
    out: dict[str, list[str]] = {}
    for r in bounded(some, "lang", rows, BYTES):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, then lang_pred, score, bits_per_byte and recognised (lengthened where docs has such names)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names, rest = fresh(docs, "lang_pred", "score", "bits_per_byte", "recognised"), docs.columns
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            lower = pc.utf8_lower(column)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(lower)
            n = np.diff(offsets)
            if m.langs:
                bits = m.lengths(data, offsets)
                best = bits.argmin(1)
                per = bits / np.maximum(n, 1)[:, None]
                gap = (per - per.min(1, keepdims=True)) * np.minimum(n, SCALE_BYTES)[:, None]
                score = 1 / np.exp2(-gap).sum(1)
                least = per.min(1)
                fits = bits.min(1) <= MARGIN * m.most[best] * n + GRACE
            else:
                letters, best, score, least, fits = letters & False, np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), letters
            lang = [m.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, least, 0.0)), pa.array(letters & fits)],
                names=rest + names,
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    return predict(docs, Model(sample(docs, rows)))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), Model(sample(docs))).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "bits_per_byte", "recognised"
    )
