"""From free text to tables: prompts, replies, flattening, keywords, complaints, topic terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from voxfare.functions import text
from voxfare.operators.ranking import (
    attach,
    dense_ranks,
    hash_order,
    once,
    salted_join,
    top_k,
    top_per_group,
    union_all,
)
from voxfare.session import checkpointed
from voxfare.sources import schemas

KEYWORD_META = (
    "review_id", "review_date", "year", "month", "seat_type", "type_of_traveller", "route",
    "reviewer_country", "overall_rating_10", "sentiment_overall", "sentiment_score",
)
CORRUPT = "_corrupt_record"
PROMPTS = 500


# ---------------------------------------------------------------- prompts and replies

def not_stated(df: DataFrame, cols: Sequence[str], value: str = text.NOT_STATED) -> DataFrame:
    """Fill missing context fields."""
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 42, cells: int = 12) -> DataFrame:
    """``n`` / ``cells`` rows of every stratum, at least one, in a fixed random order; rows without a
    stratum drop out. One pass: a task sends no more rows of a stratum than are wanted in all."""
    for s in strata:
        df = df.filter(F.col(s).isNotNull())
    return top_per_group(df, strata, [hash_order(key, seed)], max(1, n // cells))


def prompt(template: str, fields: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` places of a template with columns."""
    out = F.lit(template)
    for name, c in fields.items():
        c = F.col(c) if isinstance(c, str) else c
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit(text.NOT_STATED)))
    return out


def extract(df: DataFrame, prompt_col: str, reply_col: str, extractor: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Add the replies of an extraction function, called for up to ``PROMPTS`` prompts at a time.

    Only those prompts become Python texts; the other columns pass by as Arrow data.
    """
    out_schema = StructType([*df.schema.fields]).add(reply_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PROMPTS):
                piece = batch.slice(at, PROMPTS)
                replies = pa.array(extractor(piece.column(prompt_col).to_pandas()), type=pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*piece.columns, replies], names=[*piece.schema.names, reply_col])

    return df.mapInArrow(run, out_schema)


def strip_fence(c: Column | str) -> Column:
    """The text inside a Markdown code fence, without a ``json`` tag; other text as it is."""
    c = F.col(c) if isinstance(c, str) else c
    whole = text.strip(c)
    inner = F.regexp_replace(F.try_element_at(F.split(whole, "```"), F.lit(2)), "^json", "")
    return text.strip(F.when(whole.startswith("```"), inner).otherwise(whole))


def parse_reply(df: DataFrame, reply: str, schema: StructType = schemas.EXTRACTION) -> tuple[DataFrame, DataFrame]:
    """Split rows into parsed ones (struct ``parsed``) and failures (``error``, ``raw``).

    A reply that is no JSON object, or whose values do not fit the schema, is a failure.
    """
    with_corrupt = StructType([*schema.fields]).add(CORRUPT, "string")
    body = strip_fence(reply)
    parsed = F.from_json(body, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    rows = once(df, "parsed", parsed)
    bad = F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull()
    good = rows.filter(~bad).withColumn("parsed", F.col("parsed").dropFields(CORRUPT)).drop(reply)
    errors = (
        rows.filter(bad)
        .withColumn("error", F.lit("unreadable reply"))
        .withColumnRenamed(reply, "raw")
        .drop("parsed")
    )
    return good, errors


def merge_fields(good: DataFrame, source: Sequence[str]) -> DataFrame:
    """Source columns beside the parsed fields; the parsed one wins where names clash."""
    fields = good.schema["parsed"].dataType.names
    return good.select(*[c for c in source if c not in fields], *[F.col(f"parsed.{f}").alias(f) for f in fields])


def join_list(c: Column | str) -> Column:
    """List -> text with `` | `` between; a missing list is empty text, missing items drop out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " | ")


def flatten(df: DataFrame) -> DataFrame:
    """The nested extraction as 46 flat columns; identity or score columns the input lacks are NULL."""
    have = set(df.columns)

    def own(names: Sequence[str]) -> list[Column]:
        return [F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names]

    return df.select(
        *own(schemas.FLAT_IDENTITY),
        *own(schemas.FLAT_SCORES),
        "sentiment_overall", "sentiment_score", "emotion_primary", "is_sarcastic", "sarcasm_flag_reason",
        *[F.col(f"product_themes.{t}").alias(f"theme_{t}") for t in schemas.THEMES],
        *schemas.FLAT_SIGNALS,
        join_list("sentiment_keywords.positive_words").alias("positive_keywords"),
        join_list("sentiment_keywords.negative_words").alias("negative_keywords"),
        join_list("product_implications").alias("product_implications"),
    )


def valid_years(df: DataFrame, year: str, first: int = 2016) -> DataFrame:
    return df.filter(F.col(year).isNotNull() & (F.col(year) >= first))


# ---------------------------------------------------------------- lexicon extractor

def lexicon_extract(
    df: DataFrame,
    body: str,
    positive: Sequence[str],
    negative: Sequence[str],
    themes: Mapping[str, Sequence[str]],
    limit: int | None = None,
) -> DataFrame:
    """Deterministic stand-in for a language model, in native columns over the whole text.

    Adds sentiment_overall, sentiment_score, positive_words, negative_words and a theme column per theme.
    Sentiment is the balance of positive and negative words; a theme is mentioned where a sentence has one of
    its words, and takes the balance of those sentences. ``limit`` keeps the first so many distinct words of
    either kind; without it all are kept. Each sentence is read once and reduced to its two
    counts and the themes it mentions.
    """
    of_theme: dict[str, list[str]] = {}
    for name, lexicon in themes.items():
        for w in lexicon:
            of_theme.setdefault(w, []).append(name)
    theme_of = F.create_map(*[x for w, names in of_theme.items() for x in (F.lit(w), F.array(*[F.lit(n) for n in names]))])

    lexicon_words = [*positive, *negative, *of_theme]

    def split_up(hits: Column) -> Column:
        return F.struct(
            F.filter(hits, lambda x: x.isin(*positive)).alias("p"),
            F.filter(hits, lambda x: x.isin(*negative)).alias("n"),
            F.flatten(F.transform(F.filter(hits, lambda x: x.isin(*of_theme)), lambda x: F.try_element_at(theme_of, x))).alias("t"),
        )

    def reduced(sentence: Column) -> Column:
        hits = F.filter(text.words(sentence), lambda x: x.isin(*lexicon_words))
        return F.transform(F.array(hits), split_up)[0]  # the one-element array computes the hits once

    rows = once(df, "__s", F.transform(F.split(F.lower(F.col(body)), r"[.!?\n]+"), reduced))
    pos, neg = F.flatten("__s.p"), F.flatten("__s.n")
    n_pos, n_neg = F.size(pos), F.size(neg)

    def first_words(found: Column) -> Column:
        return F.array_distinct(found) if limit is None else F.slice(F.array_distinct(found), 1, limit)

    def theme(name: str) -> Column:
        about = F.filter("__s", lambda s: F.array_contains(s["t"], name))
        net = F.aggregate(about, F.lit(0), lambda acc, s: acc + F.size(s["p"]) - F.size(s["n"]))
        return (
            F.when(F.size(about) == 0, "not_mentioned")
            .when(net > 0, "positive")
            .when(net < 0, "negative")
            .otherwise("neutral")
        )

    return rows.select(
        *df.columns,
        F.when((n_pos > 0) & (n_pos == n_neg), "mixed")
        .when(n_pos > n_neg, "positive")
        .when(n_neg > n_pos, "negative")
        .otherwise("neutral")
        .alias("sentiment_overall"),
        F.when(n_pos + n_neg > 0, (n_pos - n_neg) / (n_pos + n_neg)).otherwise(0.0).alias("sentiment_score"),
        first_words(pos).alias("positive_words"),
        first_words(neg).alias("negative_words"),
        *[theme(name).alias(f"theme_{name}") for name in themes],
    )


# ---------------------------------------------------------------- keywords

def explode_terms(
    df: DataFrame, col: str, sentiment_type: str, meta: Sequence[str] = KEYWORD_META, sep: str = r"\|"
) -> DataFrame:
    """One row per keyword of a delimited list, lower case and trimmed, with the review's own columns."""
    parts = F.transform(F.split(F.col(col), sep), lambda x: F.lower(text.strip(x)))
    keyword = F.explode(F.filter(parts, lambda x: x != ""))
    return df.select(*meta, keyword.alias("keyword")).withColumn("sentiment_type", F.lit(sentiment_type))


def explode_typed(df: DataFrame, cols: Mapping[str, str], meta: Sequence[str], sep: str = r"\|") -> DataFrame:
    """``explode_terms`` of several delimited lists in one pass; ``cols`` maps each column to its sentiment type."""

    def listed(col: str, kind: str) -> Column:
        parts = F.transform(F.split(F.col(col), sep), lambda x: F.lower(text.strip(x)))
        known = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(x.alias("keyword"), F.lit(kind).alias("sentiment_type")))
        return F.coalesce(known, F.array().cast("array<struct<keyword:string,sentiment_type:string>>"))

    each = F.explode(F.concat(*[listed(c, k) for c, k in cols.items()])).alias("__t")
    return df.select(*meta, each).select(*meta, "__t.*")


def term_rank(df: DataFrame, term: str, by: Sequence[str] = ()) -> DataFrame:
    """Frequency and dense rank of every distinct term."""
    counts = df.filter(F.col(term).isNotNull()).groupBy(*by, term).agg(F.count(F.lit(1)).alias("frequency"))
    return dense_ranks(counts, "frequency", "rank_global", by)


def ranked_terms(df: DataFrame, term: str = "keyword") -> DataFrame:
    """Rows with the frequency and rank of their term; hot terms are salted in the join.

    The rows are written once to the shared folder, so the texts behind them are read and cut into terms once, not
    once for the counts and once for the rows.
    """
    rows = checkpointed(df, "terms")
    return salted_join(rows, term_rank(rows, term), [term])


def combined_terms(*tables: DataFrame, term: str = "keyword") -> DataFrame:
    """Rows of all types under each other, written once, with the row count of (type, term) on each row."""
    rows = checkpointed(union_all(*tables), "terms")
    counts = rows.groupBy("sentiment_type", term).agg(F.count(F.lit(1)).alias("freq_within_type"))
    return salted_join(rows, counts, ["sentiment_type", term])


def voice_frequency(df: DataFrame, col: str, name: str) -> DataFrame:
    """Frequency and dense rank of distinct complaints or praises."""
    texts = df.select(text.clean_voice(col).alias(name))
    return term_rank(texts, name).withColumnRenamed("rank_global", "rank")


def voice_detail(df: DataFrame, col: str, meta: Sequence[str]) -> DataFrame:
    """Review rows with their complaint or praise, its frequency and rank; placeholders drop out."""
    rows = checkpointed(df.select(*meta, text.clean_voice(col).alias(col)).filter(F.col(col).isNotNull()), "voices")
    ranks = term_rank(rows, col).withColumnRenamed("rank_global", "rank")
    return salted_join(rows, ranks, [col], "left")


# ---------------------------------------------------------------- topic terms

def tokens(
    df: DataFrame, col: str, keep: Sequence[str], brand_words: Iterable[str] = (), stop: Iterable[str] | None = None
) -> DataFrame:
    """One row per word with its place in the text; stop words are left out before the rows multiply."""
    stop = list(stop) if stop is not None else list(text.stop_words(brand_words))
    places = F.posexplode(text.words(col)).alias("pos", "word")
    return df.select(*keep, places).filter(~F.col("word").isin(*stop))


def cluster_terms(
    df: DataFrame, col: str, cluster: str, key: str, k: int = 3, kind: str = "Complaint",
    brand_words: Iterable[str] = (),
) -> DataFrame:
    """Label of each cluster: its ``k`` most frequent words, the earlier word first on ties.

    ``key`` orders the texts. A cluster without words is called ``General <kind>``.
    """
    words = tokens(df.filter(F.col(cluster).isNotNull()), col, [cluster, key], brand_words)
    if isinstance(df.schema[key].dataType, IntegralType):
        # One number for (key, place): a fixed-width buffer, so the counting can hash instead of sort.
        place = F.col(key).cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    else:
        place = F.struct(key, "pos")
    counts = words.groupBy(cluster, "word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = top_per_group(counts, [cluster], [F.desc("n"), F.asc("first")], k)
    label = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "word"))),  # k rows per group
            lambda s: F.initcap(s["word"]),
        ),
        " ",
    )
    named = best.groupBy(cluster).agg(label.alias("cluster_label"))
    every = df.filter(F.col(cluster).isNotNull()).select(cluster).distinct()
    return every.join(named, cluster, "left").select(
        cluster, F.coalesce("cluster_label", F.lit(f"General {kind}")).alias("cluster_label")
    )


def term_weights(df: DataFrame, col: str, key: str, brand_words: Iterable[str] = (), stop: Iterable[str] | None = None) -> DataFrame:
    """TF-IDF of every (text, word) over the whole vocabulary: ``key``, word, tf, df, idf and weight = tf * idf.

    Words count as themselves, not by hash buckets, and their table is never gathered. idf = ln((N + 1) / (df + 1)) over the N texts that
    are not NULL. ``key`` is unique. A text without words has no row.
    """
    counts = checkpointed(tokens(df, col, [key], brand_words, stop).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    known = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(col)).scalar()
    out = salted_join(counts, known, ["word"]).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)))
    return out.select(key, "word", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def cluster_examples(df: DataFrame, cluster: str, key: str, col: str, k: int = 3) -> DataFrame:
    """The first ``k`` texts of each cluster in key order, joined with bars."""
    first = top_per_group(df.select(cluster, key, col), [cluster], [F.asc(key)], k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(key, col))), lambda s: s[col])  # k rows per group
    return first.groupBy(cluster).agg(F.array_join(listed, " | ").alias("examples"))


def word_weights(df: DataFrame, lists: str, k: int = 80, brand_words: Iterable[str] = ()) -> DataFrame:
    """The ``k`` most frequent words of lists of words or phrases, with weights relative to the first."""
    joined = df.select(F.array_join(F.col(lists), " ").alias("t"))
    counts = tokens(joined, "t", [], brand_words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(counts, "n", ["word"], k)
    most = counts.agg(F.max("n")).scalar()
    return best.withColumn("weight", F.col("n") / most)


def with_label(df: DataFrame, labels: DataFrame, cluster: str) -> DataFrame:
    """Cluster label on each row."""
    return attach(df, labels, [cluster], "left")
