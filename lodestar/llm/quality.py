"""Host-level quality rules.

Each document is held against a few rules.  Failures are counted for each host
(the source), and each host's rate for each rule is shrunk towards that of all
documents by a beta prior fitted to the hosts' rates.  A host that, after that,
still fails a rule too often is rejected with all its documents; a host with few
documents cannot be, on their account alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words
from lodestar.llm.rows import map_rows
from lodestar.llm.shared import settle

#: Symbols that prose has few of.
SYMBOLS = "#*$%&|<>"
#: A document fails in base below these words, or above this percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A host is rejected from this shrunk rate of failures on.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR = (2.0, 10_000.0)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(hashes: np.ndarray) -> int:
    """Words within runs of three words that stand twice or more."""
    if len(hashes) < 4:
        return 0
    runs = words.shingles(hashes, 3)
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    inside = np.zeros(len(hashes), bool)
    for j in range(3):
        inside[j : j + len(again)] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    buf = np.frombuffer(data, np.uint8)
    starts_char = (buf & 0xC0) != 0x80
    hashes = words.word_hashes(data)
    chars = int((starts_char & ~words.SPACE[buf]).sum())
    return len(hashes), chars, int(_SYMBOL[buf].sum()), duplicate_lines(text), repeated_words(hashes)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, host and the five counts, one row for each row of docs. Null text: no words."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("host"), F.col(text_col).alias("text"))
    return map_rows(
        picked, ["doc_id", "host", "text"], "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long",
        lambda: lambda doc_id, host, text: [(doc_id, host, *counts(text))],
    )


#: Rule and when a document fails it, as SQL over the counts.
RULES = (
    ("few_words", f"n_words < {LEAST_WORDS}"),
    ("repeats", f"100 * n_repeat_words > {MOST_REPEATED} * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("dup_lines", "10 * n_dup_lines > n_words"),
)
BASE_RULES = ("few_words", "repeats")


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_docs, host_failures, worst_rate, host_rejected.

    Prior of a rule: the beta distribution by moments of all hosts, each weighed by
    its documents.  Its mean is the rate over all documents; its strength follows
    from the part of the hosts' variance beyond what drawing that many documents
    from one rate leaves.  No such part, or one host: the strongest prior allowed.
    Sums are of integers or of decimals, so they do not depend on the order of rows.
    """
    names = [n for n, _ in RULES]
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(F.expr(test)).alias(n) for n, test in RULES])
    rates = hosts.unpivot(["host", "host_docs"], names, "rule", "failures")
    exact = lambda x: F.sum(F.expr(f"cast(round({x}, 6) as decimal(34, 6))")).cast("double")
    prior = rates.groupBy("rule").agg(F.sum("failures").alias("k"), F.sum("host_docs").alias("n"), F.count("*").alias("hosts"), exact("failures * failures / host_docs").alias("kk"), exact("cast(host_docs as double) * host_docs").alias("nn"))
    prior = prior.withColumn("mean", F.col("k") / F.col("n")).withColumn("noise", F.col("mean") * (1 - F.col("mean")))
    between = (F.col("kk") - F.col("k") * F.col("mean")) - F.col("noise") * (F.col("hosts") - 1)
    most = F.col("noise") * (F.col("n") - F.col("nn") / F.col("n") - (F.col("hosts") - 1))
    prior = prior.withColumn("share", F.when((between > 0) & (most > 0), between / most))
    weight = F.when(F.col("share").isNotNull(), 1 / F.col("share") - 1).otherwise(F.lit(PRIOR[1]))
    prior = prior.select("rule", "mean", F.greatest(F.lit(PRIOR[0]), F.least(F.lit(PRIOR[1]), weight)).alias("weight"))
    shrunk = rates.join(F.broadcast(prior), "rule").withColumn("shrunk", (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("host_docs") + F.col("weight")))  # prior: a row for each rule
    return shrunk.groupBy("host").agg(F.first("host_docs").alias("host_docs"), F.sum("failures").alias("host_failures"), F.max("shrunk").alias("worst_rate"), (F.max("shrunk") >= limit).alias("host_rejected"))


def judge(docs: DataFrame, *, limit: float = HOST_LIMIT, **columns) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, host, host_docs, host_failures, worst_rate, host_rejected.

    One row for each row of docs.  A null source is a host of its own; null and empty
    texts fail as too short; repeated rows count each.  An empty table gives no rows.
    """
    measured = settle(measure(docs, **columns), "quality")
    verdicts = host_verdicts(measured, limit).withColumnRenamed("host", "_host")
    base = F.expr(" or ".join(f"({test})" for n, test in RULES if n in BASE_RULES))
    joined = measured.withColumn("base_failed", base).join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


#: The same in DuckDB's SQL, for the columns that the query returns and a limit to be filled in.
ORACLE_AT = r"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
p as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
t as (select r, i, word, lead(word, 1) over o as w2, lead(word, 2) over o as w3 from p window o as (partition by r order by i)),
g as (select *, count(*) over (partition by r, word, w2, w3) as n from t where w3 is not null),
m as (select distinct r, i + j as i from g, range(0, 3) x(j) where n >= 2),
rep as (select r, count(*) as n_repeat_words from m group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
c as (select d.doc_id, d.host, cast(len(w.ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(len(regexp_extract_all(d.text, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(dup.n_dup_lines, 0) as n_dup_lines, coalesce(rep.n_repeat_words, 0) as n_repeat_words
      from d join w using (r) left join rep using (r) left join dup using (r)),
f as (select *, n_words < 50 as a, 100 * n_repeat_words > 50 * n_words as b, 10 * n_symbols > n_words as s, word_chars < 2 * n_words or word_chars > 12 * n_words as x, 10 * n_dup_lines > n_words as y from c),
h as (select host, count(*) as n, count(*) filter (a) as a, count(*) filter (b) as b, count(*) filter (s) as s, count(*) filter (x) as x, count(*) filter (y) as y from f group by host),
u as (unpivot h on a, b, s, x, y into name rule value k),
q as (select rule, sum(k) / sum(n) as mean, sum(n) as n, count(*) as hosts, sum(k) as k, cast(sum(cast(round(k * k / n, 6) as decimal(34, 6))) as double) as kk, cast(sum(cast(cast(n as double) * n as decimal(34, 6))) as double) as nn from u group by rule),
q2 as (select rule, mean, (kk - k * mean) - mean * (1 - mean) * (hosts - 1) as between_, mean * (1 - mean) * (n - nn / n - (hosts - 1)) as most from q),
z as (select rule, mean, greatest(2.0, least(10000.0, case when between_ > 0 and most > 0 then 1 / (between_ / most) - 1 else 10000.0 end)) as weight from q2),
v as (select host, max((k + mean * weight) / (n + weight)) >= {limit} as rejected from u join z using (rule) group by host)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, (f.a or f.b) as base_failed, not (f.a or f.b) and not v.rejected as kept
from f left join v on f.host is not distinct from v.host
"""


def oracle(limit: float = HOST_LIMIT) -> str:
    return ORACLE_AT.replace("{limit}", str(limit))
