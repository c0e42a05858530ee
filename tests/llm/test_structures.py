"""Conversations, manifests and shared lines against brute-force versions, and on rows that are odd."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidewire.llm import conversations, lines, manifest
from tidewire.llm.queries import QUERIES, SQL
from tests.llm.test_operators import documents

BLANK = r"[\x20\x09-\x0D]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- conversations ---------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = re.sub(BLANK + "+$", "", text)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, audit) of the cheapest edits, the least audit first, by trying all, shortest path by shortest path."""
    best, heap = None, [(0, "", "", 0)]
    import heapq

    while heap:
        cost, audit, said, n = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if not re.fullmatch(r"(s|s?(ua)*u?)", said):
            continue
        if n == len(initials) and re.fullmatch("(s?(ua)+)?", said):
            best = min(best or (cost, audit), (cost, audit))
        if len(said) <= 2 * len(initials) + 2:
            for r in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", said + r, n))
        if n < len(initials):
            heapq.heappush(heap, (cost + 2, audit + "D", said, n + 1))
            if faults[n] not in ("blank", "duplicate"):
                more = 5 * (faults[n] == "truncated")
                if initials[n] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", said + initials[n], n + 1))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", said + r, n + 1))
    return best


def rebuilt(audit, rows):
    out, last = [], ""
    rows = iter(rows)
    for e in audit:
        want = "assistant" if last == "u" else "user"
        if e == "I":
            out.append((want, ""))
        else:
            _, role, text = next(rows)
            if e == "D":
                continue
            out.append((want if e == "R" else role, text))
        last = out[-1][0][:1]
    return out


def plain_summary(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, turns = fault_of(rows), [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest([r[:1] for _, r, _ in rows], faults)
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in conversations.FAULTS), bad, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in rebuilt(audit, rows))))


def talk(seed, n):
    rnd, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rnd.randrange(0, 7) + (conv is None)):
            t = rnd.choice([turn, turn, turn, turn * 2, None, 0])
            rows.append((conv, t, rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rnd.choice([None, "", " \n", "Yes.", "No", "a b! ", "What?\n", "hm, well", "é"])))
    return rows


def test_conversation_repair_equals_brute_force(spark):
    rows = talk(1, 250)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, place int").repartition(5)
    want = {c: (0,) * 6 + ("", sha("")) for c in {r[0] for r in rows}}
    by = {}
    for c, *rest in damaged(rows):
        by.setdefault(c, []).append(tuple(rest))
    want |= {c: plain_summary(r) for c, r in by.items()}
    got = {r[0]: tuple(r)[1:] for r in conversations.repaired_summaries(df).collect()}
    assert got == want and any(not by.get(c) for c in want)
    assert conversations.repaired_summaries(df.limit(0)).count() == 0


def test_repair_gives_turns(spark):
    rows = [("a", 0, "system", "Be brief."), ("a", 1, "user", "Hm?"), ("a", 2, "user", "Hm?"), ("a", 3, "tool", "42."), ("a", 4, "user", "Go on"), ("b", 1, "user", "x.")]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert [(r.edit, r.role, r.text, r.fault) for r in got if r.conv_id == "a"] == [("K", "system", "Be brief.", None), ("K", "user", "Hm?", None), ("D", "user", "Hm?", "duplicate"), ("R", "assistant", "42.", None), ("D", "user", "Go on", "truncated")]
    assert [(r.place, r.edit, r.role, r.cost) for r in got if r.conv_id == "b"] == [(1, "D", "user", 2)]


def test_long_conversations_are_streams(spark):
    n = 60_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    got = conversations.summaries(df).collect()
    assert len(got) == 1 and got[0].audit == "K" * n and got[0].cost == 0
    assert got[0].repaired_sha256 == sha("\n".join(f"{('user', 'assistant')[i % 2]}:Turn {i}." for i in range(n)))


def test_differences_of_costs_fit():
    seen, new = set(), {conversations.packed(conversations.END)}
    while new:
        seen |= new
        new = {conversations.step(a, i, f)[0] for a in new for i, f in itertools.product("suax", (None, *conversations.FAULTS))} - seen
    assert all(max(conversations.unpacked(a)) < conversations.BASE - 6 for a in seen)


# ---- manifests -------------------------------------------------------------------------------------------------------


def level_up(nodes):
    return [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]


def plain_tree(nodes):
    """Root, and of each node its siblings up to it (None where there is none)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, k in enumerate(at):
            proofs[n].append((k & 1, nodes[k ^ 1]) if k ^ 1 < len(nodes) else None)
            at[n] = k >> 1
        nodes = level_up(nodes)
    return nodes[0], proofs


def plain_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(((r[0], leaf(r), r) for r in by[k]), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for k in langs}
    built = {k: plain_tree([x[1] for x in trees[k]]) for k in langs}
    root, top = plain_tree([built[k][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for (i, own, r), proof in zip(trees[k], built[k][1]):
            path = proof + top[n]
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None
            fold = leaf((*r[:3], r[3] + 1, r[4])) if hit else own
            for step in path:
                fold = sha(fold) if step is None else sha(step[1] + fold if step[0] else fold + step[1])
            out.append((i, own, built[k][0], root, sha("".join(s[1] for s in path if s)), fold, fold == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, levels, monkeypatch):
    if levels < 10:
        monkeypatch.setattr(manifest, "manifest", lambda *a, make=manifest.manifest, **k: make(*a, **k, levels=levels))
    rnd = random.Random(levels)
    rows = [(i, rnd.choice(["a", "é", None]), rnd.choice(["en", "en", "en", "de", "", None, "zh"]), rnd.choice([None, i]), rnd.choice([None, "", "x" * i, "été\n"])) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "a", "en", 3, "t"), (7, "a", "once", 1, "t"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string").repartition(4)
    got = [tuple(r) for r in manifest.verified(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert manifest.verified(df.limit(0)).count() == 0
    one = [tuple(r) for r in manifest.verified(df.where("lang = 'once'")).collect()]
    assert one == plain_manifest([(7, "a", "once", 1, "t")]) and one[0][2] == one[0][3] and one[0][4] == sha("")


# ---- shared lines ----------------------------------------------------------------------------------------------------


def plain_lines(rows, least=40, shared=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(f"^{BLANK}+|{BLANK}+$", "", line))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        kept, n = [], 0
        for line in (text or "").split("\n"):
            docs = held[key(line)]
            last = max((d for d in docs if d is not None), default=None)
            if len(key(line)) >= least and len(docs) >= shared and i != last:
                n += 1
            else:
                kept.append(line)
        out.append((i, len((text or "").split("\n")), n, sha("\n".join(kept))))
    return out


def lined(seed, n):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdeé😀 ") for _ in range(rnd.choice([5, 38, 39, 40, 41, 90]))).strip() + "x" for _ in range(25)]
    rows = []
    for i in range(n):
        own = [rnd.choice([rnd.choice(pool), rnd.choice(pool[:3]).upper(), f"  {rnd.choice(pool)}\t\r", "", f"only here {i} and nowhere else, {rnd.random()}"]) for _ in range(rnd.randrange(0, 9))]
        rows.append((i, "\n".join(own)))
    return [*rows, (None, pool[0]), (None, pool[1] + "\n" + pool[1]), (n, None), (n + 1, ""), (n + 2, "\n\n"), rows[4], (3, pool[2]), (n + 3, "\n".join([pool[5] + "Z" * 60] * 3000))]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = lined(seed, 120)
    df = spark.createDataFrame([(*r, b"x", 1, "z") for r in rows], "doc_id long, text string, h binary, n_lines int, drops string").repartition(4)
    got = [tuple(r) for r in lines.kept_digests(df).collect()]
    assert sorted(got, key=str) == sorted(plain_lines(rows), key=str) and any(r[2] for r in got)
    assert lines.kept_digests(df.limit(0)).count() == 0


def test_line_index_is_levelled_and_idempotent(spark, tmp_path):
    index = lines.LineIndex(spark, f"file://{tmp_path}/runs", fan=2, buckets=3)
    rnd, held = random.Random(3), {}
    for batch in range(7):
        pairs = {(bytes([rnd.randrange(40)]), 100 * batch + rnd.randrange(50)) for _ in range(60)}
        for h, d in pairs:
            held.setdefault(h, set()).add(d)
        for times in range(2):
            assert index.add(batch, spark.createDataFrame(list(pairs), "h binary, doc_id long")) == (times == 0)
    want = {(h, len(d), max(d)) for h, d in held.items() if len(d) >= 5}
    assert {(bytes(r.h), r.docs, r.last) for r in index.frequent().collect()} == want
    assert [r[0] for r in index.runs("first")] == [2, 1, 0] and sum(index._table("first", r).count() for r in index.runs("first")) == len(held)
    index.vacuum()
    again = lines.LineIndex(spark, f"file://{tmp_path}/runs", fan=2, buckets=3)
    assert {(bytes(r.h), r.docs, r.last) for r in again.frequent().collect()} == want and not again.add(3, spark.createDataFrame([], "h binary, doc_id long"))
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidewire_")]


def test_documents_with_nulls_and_clashing_columns(spark):
    docs = documents(spark)
    assert lines.kept_digests(docs).count() == docs.count() == manifest.verified(docs).count()


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name, tmp_path):
    """On small tables with nulls, which the given ones have not."""
    rows = [(c, t, r, x) for c, t, r, x in talk(5, 60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(i, t, ["en", None, "de", ""][len(t or "") % 4], [None, "a"][len(t or "") % 2], len(t) if t else None) for i, t in lined(7, 60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for t in ("conversations", "documents"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    asked = duck.execute(SQL[name])
    columns = sorted(c[0] for c in asked.description)
    place = [[c[0] for c in asked.description].index(c) for c in columns]
    want, frame = [tuple(r[k] for k in place) for r in asked.fetchall()], QUERIES[name](spark, str(tmp_path))
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert columns == sorted(frame.columns) and sorted(got, key=str) == sorted(want, key=str) and got
