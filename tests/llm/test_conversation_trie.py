"""Operator 11 against its SQL and a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from veridian.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def spark_nodes(df):
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.with_shared_openings(trie.ordered_turns(df))).collect()), key=str)


def plain_nodes(rows):
    """The nodes by dictionaries of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h, source = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(source, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sql_nodes(conversations):
    con = duckdb.connect()
    if isinstance(conversations, str):
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{conversations}/conversations.parquet'")
    else:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in conversations])
    return sorted((tuple(r) for r in con.execute(trie.op11_sql()).fetchall()), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in trie.op11_conversation_trie(spark, folder).collect()), key=str)
    assert got == sql_nodes(folder)


def fixture():
    """Copies, branches below shared openings, nulls, ties, a long chain twice, turnless conversations, negative ids."""
    draw = random.Random(3)
    rows = []
    for c in range(260):
        kind = c % 5
        for t in range(draw.randint(1, 9)):
            text = f"reply {t}" if kind < 2 else f"text {draw.randint(0, 2)} " + "é" * t
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, "x"))
    for c in (900, 901, 907):  # 900 is the source of all
        rows += [(c, t, "user", f"same {t}", "x") for t in range(40)]
    rows += [(1101, 0, "user", "gone", "x"), (1100, None, None, None, "x"), (1100, None, "user", None, "x"), (1100, 3, "user", "a", "x"), (1100, 3, "user", "a", "x"), (1100, 3, "user", "b", "x")]
    rows += [(2355, 0, "a", "no source", "x"), (-5, 1, "a", "below", "x"), (-205, 1, "a", "zero", "x"), (None, 1, "a", "nobody's", "x")]
    draw.shuffle(rows)
    return rows


def test_fixture(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 7)
    monkeypatch.setattr(trie, "PIECE", 9)
    rows = fixture()
    want = plain_nodes(rows)
    assert sql_nodes(rows) == want
    assert spark_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


@pytest.mark.parametrize("rows", [
    [(7, 0, "user", "alone", "x"), (7, 1, "user", "again", "x")],
    [(200, t, "user", "one class", "x") for t in range(3)] + [(c, t, "user", "one class", "x") for c in (203, 204) for t in range(3)],
    [(8, 0, "user", "turnless after the opening", "x")],
    [(3, 0, "user", "longest " * 200_000, "x"), (4, 0, "user", "longest " * 200_000, "x"), (4, 1, None, "", "x")],
])
def test_small_tables(spark, rows):
    assert spark_nodes(spark.createDataFrame(rows, SCHEMA)) == plain_nodes(rows)


def test_empty_tables(spark):
    assert spark_nodes(spark.createDataFrame([], SCHEMA)) == []
    assert spark_nodes(spark.createDataFrame([(None, 1, "user", "x", "x")], SCHEMA)) == []


def test_last_turns(spark):
    rows = [(100, 0, "user", "hello", "x"), (100, 1, "assistant", "yes", "x")]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    nodes = trie.prefix_trie(turns, turns.groupBy("conv_id").count().withColumnRenamed("count", "len"))
    assert [(r.depth, r.chars) for r in trie.with_last_turn(nodes, turns).orderBy("depth").collect()] == [(0, None), (1, 5), (2, 3)]
