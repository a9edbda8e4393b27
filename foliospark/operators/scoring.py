"""Scoring of sections: sentences, a pluggable scorer, weighted means, temperature, labels, and resumed runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliospark.functions import patterns as P
from foliospark.functions.text import is_blank, norm_item
from foliospark.operators.entities import collapse_entities
from foliospark.operators.silver import first_present
from foliospark.operators.sentences import brand_weight, merge_fragments, split_sentences

P_NAMES = ("pos", "neu", "neg")
KEYS = ["ticker", "fiscal_year", "accession", "item"]

#: A scorer gets the sentences of a batch and gives for each the probabilities (positive, neutral, negative).
Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def scores_to_vector(scores: list[dict]) -> tuple[float, float, float]:
    """A classifier's [{label, score}, ...] as (positive, neutral, negative); labels compare in lower case, missing ones are 0."""
    by = {str(s["label"]).lower(): float(s["score"]) for s in scores}
    return tuple(by.get(label, 0.0) for label in P.LABELS)  # type: ignore[return-value]


def lexicon_probabilities(sentence: Column, positive=P.POSITIVE_WORDS, negative=P.NEGATIVE_WORDS) -> Column:
    """struct<pos, neu, neg> by word counts, inside the JVM: a deterministic stand-in for a model, and no more than that."""
    words = F.split(F.lower(sentence), "[^a-z]+")
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    p, n = count(positive), count(negative)
    total = (p + n + 2).cast("double")
    return F.struct((p / total).alias("pos"), (F.lit(2.0) / total).alias("neu"), (n / total).alias("neg"))


def score_with(sentences: DataFrame, make_scorer: Callable[[], Scorer], *, batch_size: int = 32, text_col: str = "sentence") -> DataFrame:
    """sentences with pos, neu and neg from a scorer that each Python worker makes once; batches go across documents, by length."""
    schema = StructType([*sentences.schema.fields, *(StructField(name, DoubleType()) for name in P_NAMES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for df in batches:
            scorer = scorer or make_scorer()
            order = df[text_col].str.len().sort_values(kind="stable").index
            out = {}
            for k in range(0, len(order), batch_size):
                part = order[k : k + batch_size]
                out.update(zip(part, scorer(df.loc[part, text_col].tolist())))
            probabilities = pd.DataFrame([out[i] for i in df.index], index=df.index, columns=list(P_NAMES), dtype="float64")
            yield pd.concat([df, probabilities], axis=1)

    return sentences.mapInPandas(run, schema)


def transformer_scorer(model: str, *, device: int = -1, max_tokens: int = 512) -> Callable[[], Scorer]:
    """A scorer around a text-classification model of the transformers library, where that is installed; made in the worker."""

    def make() -> Scorer:
        from transformers import pipeline

        pipe = pipeline("text-classification", model=model, device=device, top_k=None)
        return lambda batch: [scores_to_vector(s) for s in pipe(batch, truncation=True, max_length=max_tokens, batch_size=len(batch))]

    return make


def retune(pos: Column, neu: Column, neg: Column, temperature: float | None) -> list[Column]:
    """(pos, neu, neg) with odds raised to 1/temperature and normalized; unchanged for None and 0, negative ones are refused."""
    if temperature is not None and temperature < 0:
        raise ValueError("temperature must not be negative")
    if not temperature:
        return [pos, neu, neg]
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    powers = [F.pow(clip(p) / (F.lit(1.0) - clip(p)), F.lit(1.0 / temperature)) for p in (pos, neu, neg)]
    total = powers[0] + powers[1] + powers[2]
    return [p / total for p in powers]


def label_of(pos: Column, neu: Column, neg: Column) -> Column:
    """The label of the largest value; ties go to positive, then neutral."""
    return F.when((pos >= neu) & (pos >= neg), "positive").when(neu >= neg, "neutral").otherwise("negative")


def prepare(silver: DataFrame, *, columns: dict[str, str] | None = None, items: tuple[str, ...] = ("1A", "7")) -> DataFrame:
    """silver under its canonical column names, with synthesized ones where they are missing, and only the wanted items with text.

    columns maps names in silver to canonical ones. fiscal_year comes from year, item from section, filing_date is January 1
    of the year, accession is ticker-year.
    """
    df = silver
    for source, target in (columns or {}).items():
        if source in df.columns and source != target:
            df = (df.drop(target) if target in df.columns else df).withColumnRenamed(source, target)
    for target, names in (("fiscal_year", ("year",)), ("item", ("section",))):
        if target not in df.columns and (name := first_present(df, names)):
            df = df.withColumn(target, F.col(name))
    missing = {"ticker", "fiscal_year", "item", "text"} - set(df.columns)
    if missing:
        raise ValueError(f"the sections lack {sorted(missing)}")
    if "filing_date" not in df.columns:
        df = df.withColumn("filing_date", F.concat(F.col("fiscal_year").cast("string"), F.lit("-01-01")))
    if "accession" not in df.columns:
        df = df.withColumn("accession", F.concat_ws("-", F.col("ticker"), F.col("fiscal_year").cast("string")))
    df = df.withColumn("item", norm_item(F.col("item"))).where(F.col("item").isin(*P.SECTION_LABELS) & F.col("item").isin(*items))
    return df.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def unscored(sections: DataFrame, done: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """Only the sections whose keys are not in done yet, before any text is worked on."""
    if done is None:
        return sections
    there = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]  # a null ticker or year is a key like any other
    return sections.join(there, same, "left_anti")


def explode_sentences(sections: DataFrame, *, collapsed: bool, min_len: int = 25, threshold: float = 0.25) -> DataFrame:
    """One row for each merged sentence, sent_idx from 0, with its weight (1 unless collapsed)."""
    keep = [*KEYS, "filing_date"]
    rows = sections.select(*keep, F.posexplode(merge_fragments(split_sentences(F.col("text")), min_len)).alias("sent_idx", "sentence"))
    return rows.withColumn("weight", brand_weight(F.col("sentence"), threshold) if collapsed else F.lit(1.0))


def aggregate_sections(scored: DataFrame, *, model: str, collapsed: bool, threshold: float | None, temperature: float | None) -> DataFrame:
    """The gold section rows: weighted means, temperature, polarity and label. Partial sums are combined map-side."""
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    rows = scored.groupBy(*KEYS, "filing_date").agg(F.count("*").cast("int").alias("n_sentences"), mean("pos").alias("p"), mean("neu").alias("u"), mean("neg").alias("n"))
    p, u, n = retune(F.col("p"), F.col("u"), F.col("n"), temperature)
    rows = rows.select(*KEYS, "filing_date", "n_sentences", p.alias("pos_mean"), u.alias("neu_mean"), n.alias("neg_mean"))
    return rows.select(
        "ticker", "fiscal_year", "filing_date", "accession", "item", "n_sentences", "pos_mean", "neu_mean", "neg_mean",
        (F.col("pos_mean") - F.col("neg_mean")).alias("polarity"),
        label_of(F.col("pos_mean"), F.col("neu_mean"), F.col("neg_mean")).alias("label"),
        F.lit(model).alias("model"), F.lit(collapsed).alias("collapse_entities"),
        F.lit(threshold if collapsed else None).cast("double").alias("brand_density_threshold"), F.lit(temperature or None).cast("double").alias("temperature"),
    )


def sentence_rows(scored: DataFrame, *, model: str, collapsed: bool) -> DataFrame:
    """The gold sentence rows; labels from the raw probabilities, weights not normalized."""
    return scored.select(
        "ticker", "fiscal_year", "filing_date", "accession", "item", "sent_idx", "sentence", "pos", "neu", "neg", "weight",
        label_of(F.col("pos"), F.col("neu"), F.col("neg")).alias("label"), F.lit(model).alias("model"), F.lit(collapsed).alias("collapse_entities"),
    )


def scored_sentences(
    silver: DataFrame,
    *,
    aliases: DataFrame | None = None,
    done: DataFrame | None = None,
    make_scorer: Callable[[], Scorer] | None = None,
    columns: dict[str, str] | None = None,
    items: tuple[str, ...] = ("1A", "7"),
    collapse: bool = False,
    heuristic_min: int | None = 10,
    cap: int = 3,
    threshold: float = 0.25,
    min_len: int = 25,
    batch_size: int = 32,
) -> DataFrame:
    """Every sentence with its weight and probabilities. Blank texts and texts without sentences give none.

    Without make_scorer the lexicon scores. Write the result where both section and sentence rows are made from it, so that a
    model sees each sentence once.
    """
    rows = unscored(prepare(silver, columns=columns, items=items), done)
    if collapse:
        rows = rows.withColumn("_key", F.xxhash64(*KEYS))
        known = aliases if aliases is not None else rows.sparkSession.createDataFrame([], "ticker string, alias string")
        rows = collapse_entities(rows, known, "_key", heuristic_min=heuristic_min, cap=cap)
    sentences = explode_sentences(rows, collapsed=collapse, min_len=min_len, threshold=threshold)
    if make_scorer is not None:
        return score_with(sentences, make_scorer, batch_size=batch_size)
    return sentences.withColumn("_p", lexicon_probabilities(F.col("sentence"))).select("*", "_p.pos", "_p.neu", "_p.neg").drop("_p")


def score_sections(silver: DataFrame, *, model: str = "lexicon", temperature: float | None = None, collapse: bool = False, threshold: float = 0.25, **how) -> tuple[DataFrame, DataFrame]:
    """(section rows, sentence rows), both from scored_sentences, whose options the others are."""
    scored = scored_sentences(silver, collapse=collapse, threshold=threshold, **how)
    return aggregate_sections(scored, model=model, collapsed=collapse, threshold=threshold, temperature=temperature), sentence_rows(scored, model=model, collapsed=collapse)
