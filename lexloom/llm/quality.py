"""Quality rules with thresholds that adapt to each language and source.

Every text is measured by a few whole-number metrics (parts per thousand, or
hundredths of a character).  Each language and source has a sketch of each
metric: counts by bucket, where a bucket holds the values that share their
leading six binary digits, so a quantile is right to one part in 32.  Sketches
merge by adding their counts, in any order and grouping: a group of fewer than
``min_docs`` texts uses the merged sketch of its language, or of everything.

A metric's limits are the quartiles, moved out by ``fences`` times their
distance plus the metric's slack, and for each text by ``noise`` standard errors of
that limit over what the text has to show: sqrt(h (1000 - h) / n) for a share whose
upper limit is h, where n is the text's characters for symbols, and its words for
capitals, digits and repeats, which come by whole words; WORD_SPREAD / sqrt(n) for
the length of words. A short text is thus judged mildly, but can be rejected by every
metric, and a long one gets no allowance to speak of. Texts within the limits of all
metrics are kept.

Defined cases: null language or source is a group of its own; null and empty
texts (and those without a word) are not kept; repeated rows count and are kept
as often as they occur; ties in a quantile take the lower bucket; other columns
are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .session import cut

#: metric -> (slack, checked below, checked above)
METRICS = {"symbols": (60, False, True), "capitals": (100, False, True), "digits": (100, False, True), "repeats": (100, False, True), "word_length": (250, True, True)}
FENCES, MIN_DOCS, NOISE = 3, 50, 3
#: Standard deviation of the length of a word, in hundredths of a character.
WORD_SPREAD = 250

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_CAPITAL, _DIGIT, _FIRST = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = _DIGIT[48:58] = True
_FIRST[128:192] = False


def _allowance(metric: str, noise: int) -> str:
    """What is added to a limit of a text, as SQL of either engine."""
    if metric == "word_length":
        return f"floor({noise * WORD_SPREAD} / sqrt(greatest(n_words, 1)))"
    high = f"greatest(least(high_{metric}, 1000), 0)"
    return f"floor({noise} * sqrt({high} * (1000 - {high}) / greatest({'n_chars' if metric == 'symbols' else 'n_words'}, 1)))"


def _checks(noise: int) -> str:
    """Whether a text is within all limits, as SQL of either engine."""
    found = [f"{k} >= low_{k} - {_allowance(k, noise)}" for k, v in METRICS.items() if v[1]]
    return " AND ".join(["n_words > 0", *found, *(f"{k} <= high_{k} + {_allowance(k, noise)}" for k, v in METRICS.items() if v[2])])


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, n_chars and the metrics of each text; parts per thousand are of its characters (repeats: of its words that equal the one before)."""
    data, offs = tk.buffers(column)
    text = tk.Words(column)
    n_words = np.diff(text.first)
    chars = np.maximum(_sums(_FIRST[data], offs) - 1, 1)
    letters = _sums(_FIRST[text.data] & tk.word_bytes(text.data), text.offsets)
    word = text.hashes()
    same = np.zeros(len(word), dtype=bool)
    same[1:] = word[1:] == word[:-1]
    same[text.first[:-1][text.first[:-1] < len(word)]] = False
    per = np.maximum(n_words, 1)
    return {
        "n_words": n_words,
        "n_chars": chars,
        "symbols": 1000 * _sums(_SYMBOL[data], offs) // chars,
        "capitals": 1000 * _sums(_CAPITAL[data], offs) // chars,
        "digits": 1000 * _sums(_DIGIT[data], offs) // chars,
        "repeats": 1000 * _sums(same, text.first) // per,
        "word_length": 100 * letters // per,
    }


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, lang, source, n_words, n_chars and the metrics."""
    names = ["n_words", "n_chars", *METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, batch.schema.names[3]):
                found = measure(part.column(3))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(found[k].astype(np.int64)) for k in names)], names=[*batch.schema.names[:3], *names])

    wanted = df.select(df[id_col].cast("bigint"), df[lang_col].cast("string").alias("lang"), df[source_col].cast("string").alias("source"), df[text_col].cast("string").alias("text"))
    return wanted.mapInArrow(tk.tidy(run), f"`{id_col}` bigint, lang string, source string, " + ", ".join(f"{k} bigint" for k in names))


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: mergeable by adding n."""
    stack = F.expr(f"stack({len(METRICS)}, " + ", ".join(f"'{k}', {k}" for k in METRICS) + ") AS (metric, value)")
    low = F.expr("CASE WHEN value < 64 THEN value ELSE shiftleft(shiftright(value, length(bin(value)) - 6), length(bin(value)) - 6) END")
    return metrics.where("n_words > 0").select("lang", "source", stack).withColumn("bucket", low).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, docs, q1 and q3 of the sketches merged by keys."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("docs", F.sum("n").over(group)).withColumn("up_to", F.sum("n").over(group.orderBy("bucket")))
    at = lambda k: F.min(F.when(F.col("up_to") * 4 >= F.col("docs") * k, F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def limits(sketch: DataFrame, fences: int = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source and low_<metric>, high_<metric> of every group."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("docs").alias("ld"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    overall = quartiles(sketch, []).select(F.col("metric").alias("am"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    joined = own.join(by_lang, own.lang.eqNullSafe(F.col("l")) & (own.metric == F.col("lm"))).join(overall, own.metric == F.col("am"))
    pick = lambda q, l, a: F.when(F.col("docs") >= min_docs, F.col(q)).when(F.col("ld") >= min_docs, F.col(l)).otherwise(F.col(a))
    chosen = joined.select("lang", "source", "metric", pick("q1", "l1", "a1").alias("q1"), pick("q3", "l3", "a3").alias("q3"))
    slack = F.create_map(*[F.lit(x) for k, v in METRICS.items() for x in (k, v[0])])[F.col("metric")]
    spread = fences * (F.col("q3") - F.col("q1")) + slack
    bounds = chosen.select("lang", "source", "metric", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    cols = [F.max(F.when(F.col("metric") == k, F.col(side))).cast("bigint").alias(f"{side}_{k}") for k in METRICS for side in ("low", "high")]
    return bounds.groupBy("lang", "source").agg(*cols)


def quality_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fences: int = FENCES, min_docs: int = MIN_DOCS, noise: int = NOISE) -> DataFrame:
    """``id_col``, lang, source, n_words and the metrics of the texts that are kept."""
    metrics = cut(measured(df, id_col, text_col, lang_col, source_col))
    bounds = limits(sketches(metrics), fences, min_docs).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = metrics.join(bounds, metrics.lang.eqNullSafe(F.col("g_lang")) & metrics.source.eqNullSafe(F.col("g_source")))
    return joined.where(_checks(noise)).select(id_col, "lang", "source", "n_words", *METRICS)


def oracle_sql(fences: int = FENCES, min_docs: int = MIN_DOCS, noise: int = NOISE) -> str:
    gap = tk.WORD_GAP
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS value FROM m WHERE n_words > 0" for k in METRICS)
    cols = ", ".join(f"max(CASE WHEN metric = '{k}' THEN q1 - s END) AS low_{k}, max(CASE WHEN metric = '{k}' THEN q3 + s END) AS high_{k}" for k in METRICS)
    slack = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in METRICS.items()) + " END"

    def quart(name: str, keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""{name}_r AS (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by}) AS docs, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS up_to
  FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)),
{name} AS (SELECT {by}, max(docs) AS docs, min(CASE WHEN up_to * 4 >= docs THEN bucket END) AS q1, min(CASE WHEN up_to * 4 >= docs * 3 THEN bucket END) AS q3 FROM {name}_r GROUP BY ALL)"""

    return rf"""
WITH base AS (SELECT doc_id, lang, source, text, list_filter(string_split_regex(lower(text), '{gap}'), lambda x: x <> '') AS w, greatest(length(text), 1) AS c FROM documents),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, c AS n_chars,
  1000 * length(regexp_replace(text, '[^!-/:-@\[-`{{-~]+', '', 'g')) // c AS symbols,
  1000 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) // c AS capitals,
  1000 * length(regexp_replace(text, '[^0-9]+', '', 'g')) // c AS digits,
  1000 * coalesce(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])), 0) // greatest(len(w), 1) AS repeats,
  100 * coalesce(length(array_to_string(w, '')), 0) // greatest(len(w), 1) AS word_length FROM base),
long AS ({rows}),
sketch AS (SELECT lang, source, metric, CASE WHEN value < 64 THEN value ELSE (value >> (length(bin(value)) - 6)) << (length(bin(value)) - 6) END AS bucket, count(*) AS n FROM long GROUP BY ALL),
{quart("own", "lang, source")},
{quart("bylang", "lang")},
{quart("overall", "")},
chosen AS (SELECT own.lang, own.source, own.metric,
  CASE WHEN own.docs >= {min_docs} THEN own.q1 WHEN l.docs >= {min_docs} THEN l.q1 ELSE a.q1 END AS q1,
  CASE WHEN own.docs >= {min_docs} THEN own.q3 WHEN l.docs >= {min_docs} THEN l.q3 ELSE a.q3 END AS q3
  FROM own JOIN bylang l ON own.lang IS NOT DISTINCT FROM l.lang AND own.metric = l.metric JOIN overall a ON own.metric = a.metric),
fenced AS (SELECT *, {fences} * (q3 - q1) + {slack} AS s FROM chosen),
bounds AS (SELECT lang, source, {cols} FROM fenced GROUP BY ALL)
SELECT m.doc_id, m.lang, m.source, m.n_words, {", ".join("m." + k for k in METRICS)}
FROM m JOIN bounds b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source
WHERE {_checks(noise)}"""
