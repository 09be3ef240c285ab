"""Host-level quality rules (operator 2).

Every document is tested by rules of its own; rule failures are then added up by host, the
host's rate is shrunk towards the corpus by a beta prior fitted to all hosts, and the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of, written

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Soft rules: share of symbols to words, of repeated lines, mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 0.25, 0.3, (2.0, 12.0)


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one whole text."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \\x20 and \\x09-\\x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        end = 0  # first word that no earlier window covered
        for k, w in enumerate(windows):
            if w in often:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return (len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines))


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, measures, base_failed, soft_failed) of every row, over whole texts.

    Null text: all measures 0, so ``base_failed``.  Repeated rows each keep a row.
    """
    names = ["_id", "_host", *MEASURES, "_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*map(measure, texts_of(b, 2)))) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in got)], names)

    rows = docs.select(docs[doc_id].cast("long"), docs[host].cast("string"), docs[text].cast("string")) \
        .mapInArrow(run, "_id long, _host string, " + ", ".join(f"{x} long" for x in names[2:]))
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))) \
        .withColumn("soft_failed", (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
                    | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("_lines")) | ~mean.between(*WORD_LENGTH))


def host_verdicts(rules: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_ok) from the rows of ``document_rules``.

    The beta prior (a, b) comes from the hosts' failure rates by moments: mean m, variance v
    weighted by documents, less the binomial share of the variance.  A host's rate is
    (failed + a) / (documents + a + b), so a host with few documents stays near the corpus
    mean and is rejected only on evidence.  Documents without a host form one host.
    """
    hosts = rules.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"),
                                       F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("_bad"))
    moments = hosts.agg(F.sum("_n").alias("_all"), (F.sum("_bad") / F.sum("_n")).alias("_m"),
                        F.sum(F.col("_bad") * F.col("_bad") / F.col("_n")).alias("_sq"), F.count(F.lit(1)).alias("_hosts"))
    # sum of n * (rate - m)^2 = sum(bad^2 / n) - all * m^2; its expectation without any spread is (hosts - 1) m (1 - m)
    m = F.col("_m")
    between = (F.col("_sq") - F.col("_all") * m * m - (F.col("_hosts") - 1) * m * (1 - m)) \
        / F.greatest(F.col("_all") - F.col("_hosts"), F.lit(1))
    strength = F.least(F.greatest(m * (1 - m) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1e6))
    prior = moments.select((F.greatest(m, F.lit(1e-6)) * strength).alias("_a"),
                           (F.greatest(1 - m, F.lit(1e-6)) * strength).alias("_b"))
    rate = (F.col("_bad") + F.col("_a")) / (F.col("_n") + F.col("_a") + F.col("_b"))
    return hosts.join(F.broadcast(prior)) \
        .select("_host", F.col("_n").alias("host_docs"), F.col("_bad").alias("host_failed"), rate.alias("host_rate"),
                (rate <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          max_rate: float = 0.5) -> DataFrame:
    """Measures and verdict of every row: ``kept`` unless its own base rules or its host fail.

    A soft rule alone counts against the host, not the document.  The measures are written
    once; hosts are aggregated map-side, so a host with a third of all rows is one small
    row per task.  An empty table gives an empty table; further columns are not read.
    """
    rules = written(document_rules(docs, doc_id, text, host))
    verdicts = host_verdicts(rules, max_rate).withColumnRenamed("_host", "_h")
    return rules.join(verdicts, F.col("_host").eqNullSafe(F.col("_h")), "left") \
        .select(F.col("_id").alias("doc_id"), *MEASURES, "base_failed",
                (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"),
                "soft_failed", "host_rate", F.col("host_ok"))
