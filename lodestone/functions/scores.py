"""Tokens, term weights and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Teacher scores of prefixes of so many codes count less.
DECAY = {4: 0.5, 8: 0.75, 16: 0.875, 32: 1.0}


def tokens(text: Column, most: int | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return found if most is None else F.slice(found, 1, most)


def saturate(x: Column) -> Column:
    """log(1 + relu(x))."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def reciprocal_rank(rank: Column, k: int = 10) -> Column:
    return F.when(rank <= k, 1.0 / rank).otherwise(0.0)


def decay(length: int) -> float:
    return DECAY[length]


def scaled(scores: Column, factor: float) -> Column:
    return F.transform(scores, lambda x: x * factor)


def reg_weight(step: Column, top: float, steps: int) -> Column:
    """A weight that grows with the square of the step, up to ``top``."""
    return top * F.pow(F.least(step, F.lit(steps)) / steps, 2)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def title_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", title, text)


def dataset_name(path: Column) -> Column:
    """The label of a path: that of the first rule of which it holds all parts."""
    # The rules in their order.
    rules = [
        ("TREC_DL_2019", ["TREC_DL_2019"]),
        ("TREC_DL_2020", ["trec2020"]),
        ("TREC_DL_2020", ["TREC_DL_2020"]),
        ("MSMARCO_TRAIN", ["msmarco", "train_queries"]),
        ("MSMARCO", ["msmarco"]),
        ("MSMARCO_v2_dev1", ["MSMarco-v2", "dev_1"]),
        ("MSMARCO_v2_dev2", ["MSMarco-v2", "dev_2"]),
        ("TOY", ["toy"]),
        ("NQ_320K", ["nq-320k"]),
    ]
    out = F.lit("other_dataset")
    for label, parts in reversed(rules):
        held = F.lit(True)
        for part in parts:
            held = held & path.contains(part)
        out = F.when(held, F.lit(label)).otherwise(out)
    return out
