"""Secret scan with linking of credentials that come in parts.

Three patterns find secrets that speak for themselves.  Others are weak: a
random-looking string, a short password, a login name, an address of a service.
Such a part is reported only where a part that complements it stands near:
secrets need an identifier or an endpoint, identifiers and endpoints a secret.
Parts meet by an interval join: each side is put in bins as wide as the scope,
and a bin keeps only its first and last place of each role, which decide
whether any part lies within the scope.  So the join grows with the parts, also
where thousands stand in one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.rows import map_rows
from lodestar.llm.shared import bare_names, settle

#: Parts further apart than this, in characters from start to start, are not of one credential.
SCOPE = 300
#: A longer weak part counts as a part from each so many characters on.
LONG = 200

#: The patterns of the base scan, in the order of their kinds.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_id", "linked_endpoint")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Weak parts.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/=_-])")
SHORT = re.compile(r"""(?i:\b(?:password|passwd|passphrase|pwd|secret|auth))["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""", re.ASCII)
LOGIN = re.compile(r"""(?i:\b(?:user|username|login|client_?id|account_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,}+)""", re.ASCII)
ENDPOINT = re.compile(r"""(?i:\b(?:https?|ftp|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ssh)://[^\s"'<>]{4,}+)|(?<![A-Za-z0-9-])(?<![A-Za-z0-9-]\.)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.amazonaws\.com\b""", re.ASCII)
#: A random string needs a third of its characters to be different ones, up to this length; letters and digits of base64 are too few for more.
VARIED = 96
SECRET, ID, PLACE = 0, 1, 2
#: Where an address's query or other text may begin, where its host ends, and what stands before a piece of a path.
TAIL, AFTER_HOST, PATH = re.compile("[?#&,;]"), re.compile("[/?#&,;]"), ".:@%~"


def base(text: str) -> list[tuple[int, int, int]]:
    """kind, start and end of the base spans, in order of kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def _looks_random(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x) and len(set(x)) * 3 >= min(len(x.rstrip("=")), VARIED)


def _first(pattern: re.Pattern, text: str, start: int, end: int) -> int:
    m = pattern.search(text, start, end)
    return m.start() if m else end


def weak(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """role, start and end of weak parts that no base span and no earlier part overlaps.

    An address runs to its natural end, so parts may stand within: named ones after
    its host, and random strings that do not look like a piece of a path.  Base spans
    in its query, or in what follows without a space, leave the address a part.
    """
    busy = sorted((s, e) for _, s, e in taken)
    found: list[tuple[int, int, int]] = []
    drafts = [(SECRET, *m.span()) for m in RANDOM.finditer(text) if _looks_random(m[0])]
    bare = {d[1] for d in drafts}
    if ":" in text or "=" in text:
        drafts += [(SECRET, *m.span(1)) for m in SHORT.finditer(text)]
        drafts += [(ID, *m.span(1)) for m in LOGIN.finditer(text)]
    if "://" in text or "amazonaws" in text:
        drafts += [(PLACE, *m.span()) for m in ENDPOINT.finditer(text)]
    if not drafts:
        return found
    drafts.sort(key=lambda x: (x[1], x[0], -x[2]))
    n, last, host, address = 0, -1, -1, -1
    for role, start, end in drafts:
        while n < len(busy) and busy[n][1] <= start:
            n += 1
        hidden = start < last or (n < len(busy) and busy[n][0] < (_first(TAIL, text, start, end) if role == PLACE else end))
        if start < address:
            hidden |= role == PLACE or start < host or (start in bare and text[start - 1] in PATH)
        if hidden:
            continue
        found.append((role, start, end))
        if role == PLACE:
            host, address = _first(AFTER_HOST, text, text.find("://", start, end) + 3 if "://" in text[start:end] else start, end), end
        else:
            last = end
    return found


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text_key, base: array<struct<kind, start, end>>, weak: array<struct<role, start, end>>."""

    def row(doc_id: int, key: int, text: str | None) -> Iterator[tuple]:
        text = text or ""
        spans = base(text)
        yield doc_id, key, spans, weak(text, spans)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    spans = "array<struct<{}: int, start: long, `end`: long>>"
    found = map_rows(picked, ["doc_id", "text_key", "text"], f"doc_id long, text_key long, base {spans.format('kind')}, weak {spans.format('role')}", lambda: row)
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, kind, start, end of the weak parts with a complement in scope."""
    some = found.where(F.size("weak") > 0)
    weak_parts = some.select("row", F.explode("weak").alias("p")).select("row", "p.role", "p.start", "p.end", F.expr(f"explode(sequence(p.start, greatest(p.start, p.`end` - 1), {LONG}L))").alias("at"))
    base_parts = some.where(F.size("base") > 0).select("row", F.explode("base").alias("p")).select("row", F.when(F.col("p.kind") == 1, ID).otherwise(SECRET).alias("role"), F.col("p.start").alias("at"))
    bin_of = F.floor(F.col("at") / scope)
    ends = weak_parts.select("row", "role", "at").unionByName(base_parts).groupBy("row", "role", bin_of.alias("bin")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    asks = weak_parts.withColumn("bin", F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)))
    other = ends.withColumnRenamed("role", "other")
    complements = F.when(F.col("role") == SECRET, F.col("other") != SECRET).otherwise(F.col("other") == SECRET)
    near = (F.col("first") <= F.col("at") + scope) & (F.col("last") >= F.col("at") - scope)
    met = asks.join(other, ["row", "bin"]).where(complements & near)
    return met.select("row", (F.col("role") + 3).alias("kind"), "start", "end").distinct()


def _text(spans: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.`end`)), ',')")


def find(docs: DataFrame, *, scope: int = SCOPE, **columns) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, text_key, found: one row for each row of docs.

    found: array<struct<start, kind, end>>, ordered.  Null text: empty, no spans.
    """
    scanned = settle(scan(docs, **columns), "secrets")
    linked = link(scanned, scope).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    kind = "array<struct<start: bigint, kind: int, `end`: bigint>>"
    ordered = F.expr(f"array_sort(transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.`end`)))").cast(kind)
    every = scanned.select("row", "doc_id", "text_key", ordered.alias("base")).join(linked, "row", "left")
    every = every.withColumn("found", F.array_sort(F.concat("base", F.coalesce(F.col("linked").cast(kind), F.array().cast(kind)))))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return every.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("found").alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"), "text_key", "found",
    )


def redact(docs: DataFrame, *, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with each reported span of its text replaced by mark; overlapping spans by one.

    Other rows, among them null and empty texts, and other columns, whatever their
    names, are as they were; repeated rows are treated alike.  An empty table stays
    empty.
    """
    found = find(docs, scope=scope, id_col=id_col, text_col=text_col).where(F.size("found") > 0)
    spans = found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.first("found").alias("spans"))
    bare, _ = bare_names(docs)
    at, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    joined = bare.join(spans, F.col(at).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("key")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(text: str | None, starts: Sequence[int], ends: Sequence[int]) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for start, end in zip(starts, ends):
                if start >= at:
                    out += text[at:start], mark
                at = max(at, end)
            return "".join([*out, text[at:]])

        return pd.Series([one(*x) for x in zip(texts, starts, ends)], dtype=object)

    # texts without spans do not go to Python
    held = F.when(F.col("spans").isNotNull(), F.col(text))
    clean = joined.withColumn(text, F.coalesce(cut(held, F.col("spans.start"), F.col("spans.end")), F.col(text)))
    return clean.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)])
