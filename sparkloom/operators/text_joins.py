"""Joins of texts by what they contain, as equi joins on words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containment_join(texts: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """Each row of ``texts`` with each row of ``parts`` whose text it contains; both have ``column``, which is dropped, as other names must differ.

    Null texts contain nothing and are in nothing; an empty part is in every text. A part
    of three or more words (cut at single blanks) is looked up by one of its inner words:
    a text that contains the part has that word between blanks too. The word is the one
    in the fewest texts, as counted over all of them, and one in no text ends the search
    for its part. Only digests of texts go with the words; whole texts come in once the
    pairs that share a word are known, and are compared then. Shorter parts have no such
    word; they alone are compared with all texts.
    """
    t = texts.where(F.col(column).isNotNull()).withColumnRenamed(column, "_text").withColumn("_in", F.md5("_text"))
    p = parts.where(F.col(column).isNotNull()).withColumnRenamed(column, "_part").withColumn("_of", F.md5("_part"))
    words = F.split("_part", " ")
    inner = F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))
    long = p.withColumn("_inner", inner).where(F.size("_inner") > 0)
    asked = long.select("_of", F.explode("_inner").alias("_word")).distinct()
    held = t.select("_in", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).join(asked.select("_word").distinct(), "_word", "left_semi").distinct()
    counts = held.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts, "_word", "left").groupBy("_of").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("w"))).alias("_least"))
    looked = rarest.where("_least.n > 0").select("_of", F.col("_least.w").alias("_word"))
    pairs = held.join(looked, "_word").select("_in", "_of")
    met = pairs.join(long.drop("_inner"), "_of").join(t, "_in").where(F.expr("contains(_text, _part)"))
    names = [c for c in (*t.columns, *p.columns) if c not in ("_text", "_part", "_in", "_of")]
    short = t.join(p.where(F.size(inner) == 0), F.expr("contains(_text, _part)")).select(*names)
    return met.select(*names).unionByName(short)
