"""Text augmentations, each a table of rows (id, text) to one with more rows and an augmentation column."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_cases(df: DataFrame, text: str = "text") -> DataFrame:
    """The text, lower-cased and upper-cased."""
    kinds = F.array(*[F.struct(F.lit(k).alias("augmentation"), c.alias(text)) for k, c in (("same", F.col(text)), ("lower", F.lower(text)), ("upper", F.upper(text)))])
    return df.withColumn("_a", F.explode(kinds)).drop(text).select("*", "_a.*").drop("_a")


#: Rows of a keyboard, from which neighbouring keys follow.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def neighbours(c: str) -> str:
    for r, row in enumerate(ROWS):
        if (i := row.find(c.lower())) >= 0:
            near = row[max(0, i - 1) : i] + row[i + 1 : i + 2]
            for other in (r - 1, r + 1):
                if 0 <= other < len(ROWS):
                    near += ROWS[other][max(0, i - 1) : i + 1]
            return near
    return c


def misspell(text: str, rate: float, seed: str) -> str:
    """Swaps, drops, doubles, replaces by a near key, splits or merges words at a rate per character; the same for a seed."""
    rng, out, i = random.Random(seed), [], 0
    while i < len(text):
        c = text[i]
        if rng.random() < rate:
            kind = rng.randrange(6)
            if kind == 0 and i + 1 < len(text):
                out.append(text[i + 1] + c)
                i += 1
            elif kind == 1:
                pass
            elif kind == 2:
                out.append(c + c)
            elif kind == 3 and c.isalpha():
                out.append(rng.choice(neighbours(c)))
            elif kind == 4 and c.isalpha():
                out.append(c + " ")
            elif kind == 5 and c == " ":
                pass
            else:
                out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def misspellings(df: DataFrame, id_col: str = "id", text: str = "text", rates: tuple[float, ...] = (0.1, 0.2), seed: str = "m") -> DataFrame:
    @F.pandas_udf("array<struct<augmentation:string,text:string>>")
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"augmentation": f"misspell-{r}", "text": misspell(t or "", r, f"{seed}:{i}:{r}")} for r in rates] for i, t in zip(ids, texts, strict=True)])

    got = df.withColumn("_a", F.explode(run(F.col(id_col).cast("string"), F.col(text).cast("string"))))
    return got.drop(text).select("*", F.col("_a.augmentation").alias("augmentation"), F.col("_a.text").alias(text)).drop("_a")


def select_random(df: DataFrame, n: int, id_col: str = "id", seed: str = "r") -> DataFrame:
    """n of each id's augmentations, by the md5 of seed, id and augmentation."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), "augmentation"))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(order, "augmentation"))).where(F.col("_r") <= n).drop("_r")


def compose(df: DataFrame, *steps, keep_originals: bool = True) -> DataFrame:
    """Steps one after the other, each on all rows so far, and the originals."""
    out = df
    for step in steps:
        out = step(out.drop("augmentation"))
    return out.unionByName(df.withColumn("augmentation", F.lit("original"))) if keep_originals else out
