"""The registered queries of this subpackage and their SQL, where there is any."""

from __future__ import annotations

from . import decontaminate, language, lines, media, mixing, neardup, repeats, secrets, sharding, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_media": media.op2_media,
    "op3_lines": lines.op3_lines,
    "op4_neardup": neardup.op4_neardup,
    "op5_secrets": secrets.op5_secrets,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_repeats": repeats.op9_repeats,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op2_media": media.ORACLE,
    "op3_lines": lines.ORACLE,
    "op4_neardup": neardup.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op9_repeats": repeats.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
