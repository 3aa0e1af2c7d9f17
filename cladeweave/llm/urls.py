"""URL filters: rules first, then logistic regression on hashed character n-grams.

The host is what follows the first :// up to /, ?, # or the end, A-Z lower-cased; the
path then reaches up to ?, # or the end. A null url, or one without ://, has neither. A
rule is a host and a path start; it fits its host and all subdomains when the url's path
starts with the rule's. Of the rules that fit the longest wins, of equally long ones the
first by code point. Rules are a bounded list that the caller gives.

Where no rule fits the model judges: features are character n-grams of NGRAMS lengths of
^host$ and of ^path$, hashed (host and path apart) into 2**BITS slots; it is trained by
full-batch gradient descent on a labelled URL table of `most` urls at most, those with
the smallest hashes; a url that repeats is one row of it, blocked if any label says so.
Without labels every score is 0.

Defined results: empty host and path have no n-grams but the borders' and are scored like
any other. Whole urls are read, however long. Urls that repeat are judged alike. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, slices
from .words import buffers, mix, range_hashes

BITS, NGRAMS, MOST, THRESHOLD, STEPS, RATE, DECAY = 18, (3, 4, 5), 4000, 0.5, 60, 4.0, 1e-5

#: verdict, host, path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parted(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.col("url").cast("string")
    return pages.select("page_id", host(url).alias("host"), path(url).alias("path"))


def rule_and_verdict(rules=RULES) -> tuple[Column, Column]:
    """The rule that wins and its verdict for columns host and path; null where none fits."""
    rule = verdict = None
    for say, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule = F.when(fits, F.lit(name + start)) if rule is None else rule.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(say)) if verdict is None else verdict.when(fits, F.lit(say))
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all urls, and the url of each."""
    slots, rows = [], []
    for salt, column in ((1, hosts), (2, paths)):
        framed = pa.compute.binary_join_element_wise(pa.scalar("^", column.type), pa.compute.fill_null(column, ""), pa.scalar("$", column.type), "")
        data, offsets = buffers(framed)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        for n in NGRAMS:
            at = np.arange(max(0, len(data) - n + 1))
            at = at[row[at] == row[at + n - 1]]
            h = mix(range_hashes(data, at, at + n) + np.uint64(salt))
            slots.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row[at])
    return np.concatenate(slots), np.concatenate(rows)


def _margins(slots: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Mean weight of a url's n-grams, times the root of their number, plus the bias (the last weight)."""
    sums, counts = np.bincount(rows, weights[slots], n), np.bincount(rows, minlength=n)
    return sums / np.sqrt(np.maximum(counts, 1)) + weights[-1]


def _share(margin: np.ndarray) -> np.ndarray:
    """The logistic function, with margins cut where it is 0 or 1 anyway."""
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(labelled: DataFrame, most: int = MOST, steps: int = STEPS) -> np.ndarray:
    """Weights (the bias last) from a table host, path, blocked of which `most` urls at most are used."""
    known = labelled.where(F.col("blocked").isNotNull()).groupBy("host", "path").agg(F.max("blocked").alias("blocked"))
    chosen = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most).toPandas()
    weights = np.zeros((1 << BITS) + 1)
    n = len(chosen)
    if not n:
        return weights
    slots, rows = features(pa.array(chosen["host"], pa.string()), pa.array(chosen["path"], pa.string()))
    share = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    y = chosen["blocked"].to_numpy().astype(float)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        wrong = _share(_margins(slots, rows, weights, n)) - y
        slope = np.bincount(slots, (wrong * share)[rows], len(weights)) / n
        slope[-1] = wrong.mean()
        speed = 0.9 * speed - RATE * (slope + DECAY * weights)
        weights = weights + speed
    return weights


def judge(urls: DataFrame, weights: np.ndarray, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row of parted()."""
    used = np.flatnonzero(weights)
    shared = urls.sparkSession.sparkContext.broadcast((used, weights[used]))

    def run(batches):
        at, values = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = values
        for piece in slices(batches, "path"):
            slots, rows = features(piece.column("host"), piece.column("path"))
            score = _share(_margins(slots, rows, dense, piece.num_rows)) if len(at) else np.zeros(piece.num_rows)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score)], [*piece.schema.names, "score"])

    schema = T.StructType([*urls.schema.fields, T.StructField("score", T.DoubleType())])
    scored = urls.mapInArrow(run, schema)
    rule, verdict = rule_and_verdict(rules)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_model))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most: int = MOST) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every page.

    labelled: host, path, blocked; by default the urls that a rule decides are the
    labelled table, with the rule's verdict as label.
    """
    urls = parted(pages)
    if labelled is None:
        rule, verdict = rule_and_verdict(rules)
        labelled = urls.where(rule.isNotNull()).select("host", "path", (verdict == "block").alias("blocked"))
    return judge(urls, fit(labelled, most), rules)
