"""Text rules of a correction document: application by image, hits and a report.

Rules are dicts with ``from``, ``to``, ``regex`` and ``image`` (null: all images), in order. Literal
ones are native columns; expressions are Python's, with its back-references, so a list that has any
runs in one Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import image_stem, image_stem_plain, normalize_plain

Rule = Mapping[str, object]


def scope(rule: Rule) -> str | None:
    return None if rule.get("image") is None else image_stem_plain(str(rule["image"]))


def replacer(rules: Sequence[Rule]) -> Callable[[str, str, list[int] | None], str]:
    """A function of text, image stem and hits by rule (which it adds to, if given)."""
    steps = [(i, scope(r), re.compile(str(r["from"]) if r.get("regex") else re.escape(str(r["from"]))), str(r["to"]) if r.get("regex") else str(r["to"]).replace("\\", r"\\")) for i, r in enumerate(rules)]

    def run(text: str, stem: str, hits: list[int] | None = None) -> str:
        for i, own, pattern, target in steps:
            if own is None or own == stem:
                text, n = pattern.subn(target, text)
                if hits is not None:
                    hits[i] += n
        return text

    return run


def fixer(rules: Sequence[Rule]) -> Callable[[str, str, list[int] | None], str]:
    """As ``replacer``, for a line: where no rule changes it, the rules on its normalised form; else it stays as it is."""
    run = replacer(rules)

    def fix(text: str, stem: str, hits: list[int] | None = None) -> str:
        fixed = run(text, stem, hits)
        if fixed != text:
            return fixed
        plain = normalize_plain(text)
        second = run(plain, stem, hits) if plain != text else plain
        return second if second != plain else text

    return fix


def apply_text_rules(text: Column, rules: Sequence[Rule], image: Column | None = None) -> Column:
    """Ordered replacements. A rule with an image is for that image's rows only."""
    if not any(r.get("regex") for r in rules):

        def step(c: Column, r: Rule) -> Column:
            new = F.replace(c, F.lit(r["from"]), F.lit(r["to"]))
            if r.get("image") is None:
                return new
            return c if image is None else F.when(image_stem(image) == F.lit(scope(r)), new).otherwise(c)

        return reduce(step, rules, text)
    return _in_python(replacer(rules))(text, image_stem(F.lit("") if image is None else image))


def fix_line(text: Column, rules: Sequence[Rule], image: Column | None = None) -> Column:
    """A line by the rules, or by the rules on its normalised form where none changes it."""
    return _in_python(fixer(rules))(text, image_stem(F.lit("") if image is None else image))


def _in_python(run: Callable[[str, str, list[int] | None], str]):
    @F.pandas_udf(T.StringType())
    def changed(texts: pd.Series, stems: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else run(t, s or "", None) for t, s in zip(texts, stems)], dtype=object)

    return changed


def apply_line_corrections(df: DataFrame, rules: Sequence[Rule], image: str = "image", lines: str = "lines") -> DataFrame:
    """Lines (an array of structs with ``text``) by the rules of their image, and ``corrected``, how many changed."""
    if not rules:
        return df.withColumn("corrected", F.lit(0))
    fix = fixer(rules)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def fixed(rows: pd.Series, stems: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [t if not t else fix(t, s or "", None) for t in row] for row, s in zip(rows, stems)], dtype=object)

    out = df.withColumn("_texts", fixed(F.transform(lines, lambda x: x["text"]), image_stem(F.col(image))))
    changed = F.filter(F.zip_with(lines, "_texts", lambda x, t: F.coalesce(x["text"] != t, F.lit(False))), lambda c: c)
    corrected = F.coalesce(F.when(F.col(lines).isNotNull(), F.size(changed)), F.lit(0))
    return out.withColumns({lines: F.zip_with(lines, "_texts", lambda x, t: x.withField("text", t)), "corrected": corrected}).drop("_texts")


def rule_report(df: DataFrame, rules: Sequence[Rule], image: str = "image", lines: str = "lines") -> DataFrame:
    """ord, image, source, target, hits and matched of each rule over all lines (an array of strings, or of structs with ``text``).

    Hits add up on the map side to a number for each rule; rules without any are included.
    """
    fix = fixer(rules)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counted(rows: pd.Series, stems: pd.Series) -> pd.Series:
        out = []
        for row, stem in zip(rows, stems):
            hits = [0] * len(rules)
            for text in row if row is not None else []:
                if text:
                    fix(text, stem or "", hits)
            out.append(hits)
        return pd.Series(out, dtype=object)

    texts = F.col(lines) if isinstance(df.schema[lines].dataType.elementType, T.StringType) else F.transform(lines, lambda x: x["text"])
    hits = df.select(F.posexplode(counted(texts, image_stem(F.col(image)))).alias("ord", "n")).groupBy("ord").agg(F.sum("n").alias("hits"))
    known = df.sparkSession.createDataFrame([(i, scope(r), str(r["from"]), str(r["to"])) for i, r in enumerate(rules)], "ord int, image string, source string, target string")
    total = F.coalesce("hits", F.lit(0))
    return known.join(hits, "ord", "left").select("ord", "image", "source", "target", total.alias("hits"), (total > 0).alias("matched"))
