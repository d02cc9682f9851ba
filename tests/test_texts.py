"""Markdown tables and bold pairs against a walk over the lines, and cases by hand."""

import random

import pytest

from lodestar.operators import normalize


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cut(line):
    inner = line.strip()
    inner = inner[1:] if inner[:1] == "|" else inner
    inner = inner[:-1] if inner[-1:] == "|" else inner
    return [c.strip() for c in inner.split("|")]


def walk(text):
    """(columns, rows) of each table, by a state for each line: outside, below a header, or in a body."""
    found, state = [], "outside"
    lines = text.splitlines()
    for n, line in enumerate(lines):
        bar = line.strip()[:1] == "|"
        if state == "header":
            state = "body"
        elif state == "body" and bar:
            found[-1][1].append(cut(line))
        else:
            rule = n + 1 < len(lines) and all(c and not c.strip("-:") and "-" in c for c in cut(lines[n + 1]))
            state = "header" if bar and rule else "outside"
            if state == "header":
                found.append((cut(line), []))
    return found


def same_width(tables):
    return all(len(r) == len(head) for head, rows in tables for r in rows)


def test_tables_follow_a_walk_over_lines(spark):
    rng = random.Random(3)
    lines = ["| a | b |", "|a|b", " | x |  | ", "|---|---|", "| :-: | --: |", "--- | ---", "---", "| - | -- |", "|  |  |", "||", "|", "prose", "", "a | b", "\t| 1 | 2 |\t", "| : | - |", "**k**: v", "|-|-"]
    ends = ["\n", "\n", "\n", "\r\n", "\x0b", " "]
    texts = []
    while len(texts) < 600:
        text = "".join(rng.choice(lines) + rng.choice(ends) for _ in range(rng.randrange(1, 12)))
        if same_width(walk(text)):
            texts.append(text)
    got = {}
    for r in normalize.tables(frame(spark, texts)).orderBy("table_no").collect():
        got.setdefault(r.doc_id, []).append((r.columns, r.rows))
    assert sum(map(len, got.values())) > 300
    assert {n: t for n, text in enumerate(texts) if (t := walk(text))} == got


def test_tables_by_hand(spark):
    texts = [
        "| a | b |\n|---|---|\n| 1 | 2 |\n| - | -- |\n|  |  |\n| 3 | 4\nend",  # dashes, blanks and a missing bar are rows
        "| just | prose |\n| more | prose |",  # no rule, no table
        "| a |\n|:-:|\nafter",  # no rows
        None,
        "x | a | b |\n---|---",  # a header begins with a bar
        "| p |\n| a |\n|---|\n|---|\n| b |",  # the first line with a rule below is the header
    ]
    got = {(r.doc_id, r.table_no): (r.columns, r.rows) for r in normalize.tables(frame(spark, texts)).collect()}
    assert got == {(0, 1): (["a", "b"], [["1", "2"], ["-", "--"], ["", ""], ["3", "4"]]), (2, 1): (["a"], []), (5, 1): (["a"], [["---"], ["b"]])}
    cells = normalize.table_cells(frame(spark, texts)).where("doc_id = 0 and row_no = 4").orderBy("col_no").collect()
    assert [(r.col_no, r.cell, r.header) for r in cells] == [(0, "3", "a"), (1, "4", "b")]


def test_long_tables_and_a_row_of_another_width(spark):
    long = "| a | b |\n|---|---|\n" + "\n".join(f"| {n} | - |" for n in range(60_000)) + "\n\n" + "word " * 200_000 + "|"
    assert [len(r.rows) for r in normalize.tables(frame(spark, [long])).collect()] == [60_000]
    with pytest.raises(Exception, match="not as wide as its header: 1 \\| 2 \\| 3"):
        normalize.tables(frame(spark, ["| a | b |\n|---|---|\n| 1 | 2 | 3 |"])).collect()


def pairs(text):
    """key: value by cutting each line at its marks."""
    out = {}
    for line in text.splitlines():
        parts = line.strip().split("**", 2)
        if len(parts) == 3 and parts[0] == "" and ":" in parts[2] and parts[1].strip():
            out[parts[1].strip()] = parts[2].split(":", 1)[1].strip()
    return out


def test_pairs_follow_the_lines(spark):
    rng = random.Random(4)
    pieces = ["**", "*", "k", "key two", ":", " ", "v: w", "\n", "\r\n", "  **", "**: ", "| x", "：", "(unit)", "　", "****"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(800)]
    texts += ["a **mid**: dle", "**first**: 1\n**first** (bn) : 2", "**no colon**", "** **: blank", "   **late** more: x : y  ", None]
    got = {}
    for r in normalize.bold_pairs(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.key] = r.value
    assert got == {n: p for n, t in enumerate(texts) if t and (p := pairs(t))}
    assert got[801] == {"first": "2"} and got[804] == {"late": "x : y"} and 800 not in got
