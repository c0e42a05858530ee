"""The training-data operators against brute-force versions, and on rows that are odd."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash

from tidewire.llm import ann, embed_dedup, mixing, packing, pii, quality, simhash, token_counts, token_store, tokens, toxicity
from tidewire.llm.graph import connected_components, forest
from tidewire.llm.queries import MIX_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, place int"
WORDS = "the of and stream river tide wire foam salt gull harbour wave drift anchor mast sail keel rope knot".split()


def documents(spark, seed=1, n=120):
    """Prose, copies, near copies, and rows with nulls, empty and long texts, and clashing columns."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randrange(1, 150)))
        if i % 9 == 1:
            text = rows[-1][1]
        if i % 9 == 2 and rows[-1][1]:
            text = rows[-1][1] + " " + rnd.choice(WORDS)
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "d", None]), len(text), 0.5, "x", 7))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, 1.0, "y", 1), (n + 2, " \n\t ", "en", "b", 4, 1.0, "y", 1), (n + 3, "été " * 30_000, "fr", "a", 120_000, 1.0, "y", 1)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1), (3, 7, 9)], "doc_id long, quality int, toxic int")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def components(ids, linked):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in ids if linked(i, j))]) for i in ids}
        if new == label:
            return label
        label = new


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = components(list(near), lambda i, j: j in near[i])
    got = connected_components(spark.createDataFrame([*pairs, (None, 3), (5, None)], "a long, b long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == {k: v for k, v in want.items() if near[k] != {k}}
    # hubs with the least and the largest number, which share a third of their neighbours, and one of them as a path's end
    hubs = [(0, k) for k in range(1, 3001)] + [(10_000, k) for k in range(2001, 5001)] + [(20_000, k) for k in range(20_001, 22_000)] + [(k, k + 1) for k in range(22_000, 22_050)]
    rnd.shuffle(hubs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(hubs, "a long, b long").repartition(7)).collect()}
    assert {n: got[n] for n in got if n <= 10_000} == {n: 0 for n in [*range(5001), 10_000]}
    assert {n: c for n, c in got.items() if n > 10_000} == {n: 20_000 if n < 22_000 else 22_000 for n in range(20_000, 22_051)}
    a, b = forest(np.array([5, 9, 2]), np.array([7, 5, 2]))
    assert dict(zip(a, b)) == {7: 5, 9: 5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, docs, empty, monkeypatch):
    def reference(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = texts(docs)
    fp = {i: reference(t) for i, t in rows}
    want = components(sorted(fp), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 4)
    for page in (1024, 2):  # with pages of two, nearly all links are found between pages
        monkeypatch.setattr(simhash, "PAGE", page)
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == len(rows) and all((r.fp % 2**64, r.component_id) == (fp[r.doc_id], want[r.doc_id]) for r in got)
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_finds_all_links():
    rnd = np.random.default_rng(3)
    base = rnd.integers(-(2**63), 2**63, 30)
    flips = [int(b) ^ sum(1 << int(k) for k in rnd.choice(63, rnd.integers(0, 7), replace=False)) for b in base for _ in range(40)]
    fp = np.unique(np.array(flips, np.int64))
    gray = fp.view(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    fp = fp[np.argsort(gray)]
    a, b = simhash._within(fp, np.zeros(len(fp), int), 4)
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    whole, found = (dict(zip(*map(list, forest(x, y)))) for x, y in ((fp[i], fp[j]), (a, b)))
    assert whole == found


def fresh_tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


def test_encoder_equals_the_tokenizers():
    from tokenizers import Tokenizer

    odd = ["", "a  b", "x\n\ny", " a", "b ", "don't I'LL  stop", "a\tb", "é́ x", "日本語 text 12 345", "\x00a b", "İI ΑΣ ΣΑΣ.", "a\x1cb c", "<|endoftext|> hi", "w\nnext\nthird", "a\x85b", "\x01 a\x01b", "a b", "q\n", "\nq", "word,. more!", "x" * 5000,
           "...İ!", "İ! a", "xİ", "ŉa ǅx ßẞ.", "a\n!b", "!\nb? c\n12", "été Été. naïve!", "K ﬁn", "two\n\n\nfeeds", " lead", "a b\u3000c"]
    rnd = random.Random(3)
    letters = [*"aabdeSTsİßéÉñ12.,!?'&|-(\n   ", "'LL", "<|endoftext|>", "\u0301", "Σ", "\xa0", "日", "ª"]
    odd += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, fresh = tokens.Encoder(tokens.public_path(name)), Tokenizer.from_file(tokens.public_path(name))
        for _ in range(2):  # new, then kept
            for text, ids in zip(odd, own.ids(odd)):
                assert ids == np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), (name, text)


def test_encoder_forgets_and_tells_words_of_one_hash_apart(monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(WORDS) + rnd.choice(["", ",", "x", "9", "é"]) for _ in range(rnd.randrange(30))) for _ in range(300)]
    monkeypatch.setattr(tokens, "AT_ONCE", 2000)
    for kept, hashes in ((40, tokens._hashes), (1000, lambda w: np.zeros(len(w), np.uint64)), (1000, lambda w, own=tokens._hashes: own(w) % np.uint64(7))):
        monkeypatch.setattr(tokens, "KEPT", kept)
        monkeypatch.setattr(tokens, "_hashes", hashes)
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            own, fresh = tokens.Encoder(tokens.public_path(name)), fresh_tokenizer(name)
            assert own.ids(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_equals_a_fresh_tokenizer_on_special_tokens():
    from tokenizers import Tokenizer

    odd = ["a page <|endoftext|> ends", "<|startoftext|>a", "x<|endoftext|><|endoftext|>\ny", "<|ENDOFTEXT|> a", "<|endoftext |>", "a <|endof text|>", "plain words, here."]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, fresh = tokens.Encoder(tokens.public_path(name)), Tokenizer.from_file(tokens.public_path(name))
        for _ in range(2):  # new, then kept
            for text, ids in zip(odd, own.ids(odd)):
                assert ids == np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), (name, text)


def test_packing(docs, empty):
    got = packing.pack_documents(docs).toPandas()
    own = fresh_tokenizer("word_bpe_49k.json")
    want = []
    for i, t in texts(docs):
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, s // 2048, s, len(p := ids[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum()[:-1]] and x["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1 + -(-got["length"].sum() // 2048)
    assert packing.pack_documents(empty).count() == 0


def test_fullest_is_optimal():
    rnd = random.Random(5)
    for _ in range(60):
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(5)}
        room = rnd.randrange(1, 90)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(x) <= counts[x] for x in got)
    placed = packing.plan({7: 5, 3: 9, 10: 2}, 10)
    assert sum(t * len(x) for t, x in placed) == 16 and all(sum(x) <= 10 for _, x in placed)


def test_mixing(spark, docs, empty):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = c.execute(MIX_SQL).df()
    got = mixing.mix(docs).toPandas()
    norm = lambda x: sorted(map(tuple, x[sorted(want.columns)].round(6).astype(str).to_numpy()))
    assert norm(got) == norm(want)
    by = got.groupby("source_size")[["target", "taken", "size"]].agg({"target": "first", "taken": "sum", "size": "max"})
    assert ((by["target"] - by["taken"]).abs() <= by["size"]).all() and (got["taken"] <= 2 * got["size"]).all()
    rows = mixing.repeat(docs)
    assert rows.columns == docs.columns and sum(len((r.text or "").encode().split()) for r in rows.collect()) == got["taken"].sum()
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]


def test_token_store(docs, empty, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 500)
    got = token_store.round_trip(docs).toPandas()
    own = fresh_tokenizer("byte_bpe_50k.json")
    rows = sorted((i, len(ids := [*own.encode(t, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts(docs))
    start = np.cumsum([0] + [r[1] for r in rows])[:-1].tolist()
    assert sorted(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == sorted((r[0], s, r[1], r[2]) for r, s in zip(rows, start))
    assert token_store.round_trip(empty).count() == 0


def test_code_lengths_and_book():
    rnd = np.random.default_rng(1)
    for counts in ([5], [0, 3, 0, 4], 2 ** np.arange(40), rnd.integers(0, 3, 300), np.ones(1 << 10, int)):
        counts = np.asarray(counts)
        bits = token_store.code_lengths(counts, 12)
        used = bits[counts > 0]
        assert (bits[counts == 0] == 0).all() and used.max() <= 12 and used.min() >= 1 and (0.5 ** used).sum() <= 1
        assert (0.5**used).sum() == 1 or len(used) == 1
    bits = token_store.code_lengths(counts)
    book = token_store.Book.of(bits)
    for n in (1, 63, 64, 65, 1000):
        ids = rnd.integers(0, 1 << 10, n)
        code, checkpoints = book.encode(ids)
        assert (book.decode(code, checkpoints, n) == ids).all()


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    def luhn(d):
        return sum(int(c) if n % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for n, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) < 256 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark, docs, empty):
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("ab1234567890..@@+- ()%_\n1 2é😀") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    part = lambda: rnd.choice(["0", "00", "000", "0" * 40, "1", "07", "10", "255", "0255", "256", "00256", "999", "1000", str(rnd.randrange(300))])
    rows += [rnd.choice(["", "host ", "x", "9 ", "."]) + ".".join(part() for _ in range(rnd.randrange(3, 7))) + rnd.choice(["", " up", ".", "x"]) for _ in range(1500)]
    rows += ["10.0.0.1", "host 192.168.0.7 up", "00.1.2.3", "0.0.0.0", "000.1.2.3", "0" * 4000 + ".0.0." + "0" * 4000 + "9 b"]
    rows += [None, "", "4337 1665-9846 4399 x", "a@b.c_d@e.f", "a@b.c.d.@x.y", "0001.2.3.4", "1.2.3.256", "1 " * 9000 + "x", "a.b@" + "c." * 9000 + "d", "+" + "1" * 12 + "(" * 50, "x 1.2.3.4 4337166598464399 " * 300]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(rows)], "doc_id long, text string")
    want = []
    for i, t in enumerate(rows):
        s = base_spans(t or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in s).encode()).hexdigest()
        want.append((i // 2, *(sum(k == n for _, k, _ in s) for n in range(4)), digest))
    got = [tuple(r)[:6] for r in pii.find(df).collect()]
    assert sorted(got) == sorted(want)
    assert pii.find(empty).count() == 0 and pii.find(docs).where("spans <> ''").count() == 0


def plain_seen(text, base):
    """Base spans (s, k, e) and candidates (k = -1), each with its string and patterns."""
    covered = list(text)
    for s, _, e in base:
        covered[s:e] = pii.OTHER * (e - s)
    gaps = regex.sub(pii.GAP, pii.MARK, "".join(covered)) if regex.search(pii.GAP, text) else ""

    def opened(m):
        v = m[0]
        n = min(len(v) - len(v.lstrip("(")), max(0, v.count("(") - v.count(")")))
        return m.start() + n, m.end()

    chains = [opened(m) for m in regex.finditer(pii.CHAIN, gaps) if pii.MARK in m[0]]
    tokens = [opened(m) for m in regex.finditer(pii.CANDIDATE, text)]
    free = chains + [(s, e) for s, e in tokens if not any(b < e and s < f for b, _, f in base) and not any(b <= s and e <= f for b, f in chains)]
    out = []
    for s, k, e in [*base, *((s, -1, e) for s, e in free)]:
        words = (" " + text[:s] + "!").lower().split()  # the mark keeps an end of blanks apart
        gap = words.pop()[:-1]
        patterns = []
        if not gap.strip("\"'(<"):
            if len(words) > 1:
                patterns.append(" ".join(words[-2:]))
            if words and words[-1][-1] in ":=":
                patterns.append(words[-1])
        elif (m := re.match(r"^(.*[:=])[\"'(<]*$", gap)) and len(m[1]) > 1:
            patterns.append(m[1])
        out.append((s, k, e, text[s:e].lower(), patterns))
    return out


def plain_bootstrap(texts):
    """Of each text the spans that the bootstrap adds, by loops over dictionaries."""
    seen = [plain_seen(t, base_spans(t)) for t in texts]
    graph, said = {}, {}
    for own in seen:
        for _, k, _, v, patterns in own:
            for p in patterns:
                n, most = graph.get((p, v), (0, -1))
                graph[p, v] = n + 1, max(most, k)
    for t in texts:
        words = re.split(r"[\x20\x09-\x0D]+", t.lower())
        for a, b in zip(words, [*words[1:], None]):
            for p in [f"{a} {b}"] * (b is not None) + [a[: i + 1] for i, c in enumerate(a) if c in ":="]:
                said[p] = said.get(p, 0) + 1
    seeds = {}
    for (_, v), (_, k) in graph.items():
        if k >= 0:
            seeds[v] = (max(k, seeds.get(v, (-1, 1))[0]), 1.0)
    known = dict(seeds)

    def reliability():
        sure = {}
        for p, kind in patterns.items():
            met = sum(n * known[v][1] for (q, v), (n, _) in graph.items() if q == p and v in known and known[v][0] == kind)
            sure[p] = met / (said[p] + pii.PRIOR)
        return sure

    for _ in range(pii.ROUNDS):
        kinds = {}
        for (p, v), (n, _) in graph.items():
            if v in known and known[v][1] >= pii.CONFIDENT:
                many, total = kinds.setdefault(p, {}).get(known[v][0], (0, 0))
                kinds[p][known[v][0]] = many + 1, total + n
        patterns = {}
        for p, by in kinds.items():
            kind = max(by, key=lambda k: (by[k][1], -k))
            if by[kind][0] >= pii.SUPPORT:
                patterns[p] = kind
        sure, doubt = reliability(), {}
        for p, v in graph:
            if p in patterns and v not in seeds:
                doubt.setdefault(v, {}).setdefault(patterns[p], []).append(min(sure[p], 1 - 1e-9))
        known = dict(seeds)
        for v, by in doubt.items():
            score = {k: 1 - np.prod([1 - s for s in all_]) for k, all_ in by.items()}
            kind = max(score, key=lambda k: (round(score[k], 12), -k))
            known[v] = kind, score[kind]
    good = {p for p, s in reliability().items() if s >= pii.CONFIDENT}
    return [sorted({(s, e): min(patterns[p] for q in own if q[:3] == (s, k, e) for p in q[4] if p in good) for s, k, e, _, ps in own if k < 0 and good & set(ps)}.items()) for own in seen]


def spans_of(text, added):
    every = sorted(base_spans(text) + [(s, k, e) for (s, e), k in added])
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in every)


def planted(seed):
    """Texts with identifiers behind telling words; those unseen in form, decoys, and words that only the bootstrap can learn."""
    rnd = random.Random(seed)
    phone = lambda: f"+1 (988) 555-{rnd.randrange(1000, 9999)}"
    code = lambda: f"{rnd.choice('abcdxyz')}{rnd.randrange(100, 999)}-{rnd.randrange(10, 99)}"
    codes = [code() for _ in range(12)]
    rows, unseen = [], []
    for i in range(240):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(4, 14))]
        at = rnd.randrange(1, len(words))
        kind = i % 8
        if kind < 3:
            more = ["call", "me", "at", phone()]
        elif i % 16 == 3:  # the same words before what no pattern knows
            more = ["call", "me", "at", rnd.choice(codes)]
        elif kind == 4:  # the known codes behind other words
            more = ["reach", "desk", codes[rnd.randrange(12)]]
        elif i % 32 == 5:  # new codes behind those words only
            more = ["reach", "desk", code()]
        elif kind == 6:
            more = ["room", code()]  # decoys
        else:
            more = [f"mail:{rnd.choice('abc')}{i}@foam.org", "see", code()]
        rows.append(" ".join(words[:at] + more + words[at:]))
        unseen.append(more[-1] if kind == 4 or i % 16 == 3 or i % 32 == 5 else None)
    return rows, unseen


def test_pii_bootstrap_equals_a_plain_version(spark):
    for seed in (1, 2):
        rows, unseen = planted(seed)
        rnd = random.Random(seed + 50)
        odd = ["tel:" + rnd.choice(["+49 30 901820000", "030 90 18", "x-12 y"]) + rnd.choice(["", " ", "\n"]) + 'a=b:"1.2.3.4" (00-11' for _ in range(20)]
        df = spark.createDataFrame(list(enumerate(rows + odd)), "doc_id long, text string").repartition(3)
        want = plain_bootstrap(rows + odd)
        got = {r.doc_id: r.spans for r in pii.find(df).collect()}
        assert got == {i: spans_of(t, w) for i, (t, w) in enumerate(zip(rows + odd, want))}
        # Precision and recall of what is planted: all of it is found, in the second round and later too, and nothing else.
        added = [[rows[i][s:e] for (s, e), _ in w] for i, w in enumerate(want[: len(rows)])]
        found = sum(u is not None and u in a for u, a in zip(unseen, added))
        assert found == sum(u is not None for u in unseen) > 50 and sum(map(len, added)) == found
        assert any("reach desk" in t and a for t, a in zip(rows, added))


def test_redaction_of_many_overlapping_spans(spark):
    text = " ".join(f"a{i}@b.c +1234567890{i % 10} 1.2.3.{i % 256}" for i in range(700)) + " +1.2.3.4.5.6.7.8.9 end"
    df = spark.createDataFrame([(1, text, 3, 4), (2, "x", 5, 6)], "doc_id long, text string, spans int, id int")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    want, at = "", 0
    for s, k, e in base_spans(text):
        if s >= at:
            want += text[at:s] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, e)
    assert got[1].text == want + text[at:] and got[1].spans == 3 and got[2].text == "x" and len(text) > 20_000


def test_redaction_of_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "host 192.168.0.7 up, 0.0.0.0 and 000.1.2.3.", "10.0.0.256 stays"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["[IP]", "host [IP] up, [IP] and [IP].", "10.0.0.256 stays"]


def test_pii_contexts_discover_and_spare(spark):
    rows = [(i, f"some words here please call me at +1 (988) 555-{1000 + i} and the river {i}") for i in range(8)]
    rows += [(20, "he said call me at 0171-5550{0} today".replace("{0}", "123")), (21, "a plain text about room 12345a and foam"), (22, None), (23, "mail a.b@c.de, ip 1.2.3.4")]
    df = spark.createDataFrame([(i, t, "src", 1) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[20].spans == "phone:19:31" and got[20].n_phone == 0 and got[21].spans == "" and got[0].spans.count("phone") == 1
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[20].text == "he said call me at [PHONE] today" and red[20].n_chars == len(red[20].text) and red[21].text == rows[9][1] and red[22].text is None and red[21].n_chars == 1
    assert red[23].text == "mail [EMAIL], ip [IP]"


def test_pii_discovers_spaced_bracketed_and_long_identifiers(spark):
    rows = [(i, f"some words here please call me at +1 (988) 555-{1000 + i} and the river {i}") for i in range(8)]
    unseen = ["020 7946 0958", "0171 555 0123", "4111 1111 1111 1112", "(988) 555-1000", "k3y" + "x9-y" * 20, "0171.555 (01) 23", "1.2.3-4 5678"]
    rows += [(20 + k, f"he said call me at {v}, today") for k, v in enumerate(unseen)]
    rows += [(40, "he said call me at (0171-5550123) today"), (41, "he said call me at ((988) 555 1000) today"), (42, "he said call me at 1.2.3.4 0171 555 0123"), (43, "x" + " 1" * 9000 + "(a" * 9000)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[20 + k] for k in range(len(unseen))] == [f"phone:19:{19 + len(v)}" for v in unseen]
    assert (got[40], got[41], got[42], got[43]) == ("phone:20:32", "phone:20:34", "ip:19:26", "")
    red = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 23").first()
    assert red.text == "he said call me at [PHONE], today"


def test_pii_counts_labels_as_they_are_induced(spark):
    labels = ['<a href="tel:', "url?x=1&phone=", "contact:phone:"]
    rows = [(9 * k + i, f"see {x}+1 (988) 555-{1000 + i} there") for k, x in enumerate(labels) for i in range(8)]
    rows += [(100 + k, f"see {x}0171-5550123 there") for k, x in enumerate(labels)]
    long = "w" * 70 + ":"  # its last characters are no word
    rows += [(200 + i, f"see {long} +1 (988) 555-{1000 + i} there") for i in range(8)]
    rows += [(300, f"see {'v' * 10}{long} 0171-5550123 there")] + [(310 + i, f"see {'w' * 62}: nothing") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [got[100 + k] for k in range(3)] == [f"phone:{4 + len(x)}:{16 + len(x)}" for x in labels] and got[300] == ""
    counted = {r.p: r.n for r in pii._occurrences(df, spark.createDataFrame([(x.split()[-1],) for x in labels] + [("see",), ("contact:",)], "p string")).collect()}
    assert counted == {'href="tel:': 9, "url?x=1&phone=": 9, "contact:phone:": 9, "contact:": 9}


def test_quality(spark, docs, empty, labels):
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        good = i % 4 > 0
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 90))]
        rows.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words), good))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(g)) for i, _, g in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(df, lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, g) for i, _, g in rows if got[i].held_out]
    assert len(held) > 80 and sum(p == g for p, g in held) / len(held) > 0.97
    assert sorted(r.doc_id for r in quality.keep_good(df, lab).collect()) == [i for i, _, _ in rows if got[i].predicted]
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(empty, labels).count() == 0 and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_discriminant_equals_densities():
    rnd = np.random.default_rng(2)
    mean, a = rnd.normal(size=(2, 3)), rnd.normal(size=(2, 3, 3))
    cov = a @ a.transpose(0, 2, 1) + np.eye(3)
    low = np.linalg.cholesky(cov)
    m = quality.Discriminant(np.log([0.3, 0.7]), mean, np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1))
    x = rnd.normal(size=(5, 3))
    p = [w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mean[c], np.linalg.inv(cov[c]), x - mean[c])) / np.sqrt(np.linalg.det(cov[c])) for c, w in ((0, 0.3), (1, 0.7))]
    assert np.allclose(m.score(x), p[1] / (p[0] + p[1]))


def test_toxicity(spark, docs, empty, labels):
    rnd = random.Random(4)
    bad = ["zorg", "blarg", "snarfen", "snarfest"]
    rows = []
    for i in range(500):
        toxic = i % 4 == 0
        words = [rnd.choice(WORDS) for _ in range(40)] + ([rnd.choice(bad) for _ in range(rnd.randrange(1, 6))] if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    train = spark.createDataFrame([(i, y) for i, _, y in rows if i < 350], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(df, train).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if i >= 350]) > 0.97
    few, many = ([got[i].severity for i, t, y in rows if y and ok(sum(w in bad for w in t.split()))] for ok in (lambda n: n == 1, lambda n: n > 3))
    assert np.mean(few) < np.mean(many) <= toxicity.GRADES
    assert toxicity.severity(docs, labels).count() == docs.count() and toxicity.severity(empty, labels).count() == 0
    assert {r.severity for r in toxicity.severity(docs, labels.limit(0)).collect()} == {0.0}


def test_ordinal_fit_is_the_likeliest(monkeypatch):
    """The penalised likelihood, written out, has no better parameters near those that are fitted."""
    monkeypatch.setattr(toxicity, "FEATURES", 12)
    monkeypatch.setattr(toxicity, "ROUNDS", 3000)
    rnd = np.random.default_rng(5)
    rows = [(f := np.sort(rnd.choice(12, rnd.integers(1, 6), replace=False)), 1 + rnd.random(len(f))) for _ in range(250)]
    truth = np.r_[2.0, -2.0, 1.0, np.zeros(9)]
    score = np.array([truth[f] @ v for f, v in rows]) + rnd.logistic(size=250)
    grade = np.digitize(score, [0.5, 1.5, 3.0])
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    model = toxicity.fit(toxicity.rows_of(rows), grade, 4)

    def objective(w, theta):
        loss = 0.0
        for (f, v), g in zip(rows, grade):
            p = [1.0, *(1 / (1 + np.exp(-(w[f] @ v - t))) for t in theta), 0.0]
            loss -= np.log(max(p[g] - p[g + 1], 1e-12)) / len(rows)
        return loss + toxicity.SPARSE * np.abs(w).sum()

    best = objective(model.weights, model.thresholds)
    assert (np.diff(model.thresholds) > 0).all() and best < objective(np.zeros(12), model.thresholds) - 0.05
    for k in range(15):
        for step in (0.05, -0.05):
            w, t = model.weights.copy(), model.thresholds.copy()
            (w if k < 12 else t)[k if k < 12 else k - 12] += step
            assert objective(w, t) > best - 1e-4


def vectors(spark, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(600, 24)) * rnd.uniform(0.5, 3, size=(600, 1))
    x[100:130] = x[0] + rnd.normal(size=(30, 24)) * 0.15
    x[130:160] = x[1]
    x[160:170] = 2 * x[1]
    rows = [(i, v.tolist(), "label") for i, v in enumerate(x)]
    inf, nan = float("inf"), float("nan")
    rows += [(600, None, None), (601, [0.0] * 24, ""), (602, [nan] + [1.0] * 23, ""), (603, [inf] + [1.0] * 23, ""), (604, [None] + [1.0] * 23, ""), (605, [1.0] * 3, ""), (606, [], ""), (None, [1.0] * 24, "")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(4)


def test_embedding_links(spark, monkeypatch):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = components(range(600), lambda i, j: link[i, j])
    for page, tile in ((4096, 1024), (64, 16)):
        monkeypatch.setattr(embed_dedup, "PAGE", page)
        monkeypatch.setattr(embed_dedup, "TILE", tile)
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, 0.95).collect()}
        assert len(got) == 608 and all((got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want[i], want[i] == i) for i in range(600))
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(600, 607))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_neighbours(spark):
    x, df = vectors(spark)
    queries = df.where("vec_id % 20 = 0")
    got = ann.search(df, queries, k=10).toPandas()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hit = 0
    for q in range(0, 600, 20):
        own = got[got.query_id == q].sort_values("rank")
        want = np.lexsort((np.arange(600), -score[q]))[:10]
        hit += len(set(own.vec_id) & set(want))
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, score[q][own.vec_id.astype(int)]) and (own.score.diff().dropna() <= 0).all()
    assert hit >= 0.95 * 300 and set(got.query_id) == set(range(0, 600, 20))
    copies = got[got.query_id == 140].sort_values("rank")
    assert copies.vec_id.tolist()[:10] == list(range(160, 170))
    assert ann.search(df.limit(0), queries).count() == 0 and ann.search(df, queries.limit(0)).count() == 0
    few = ann.search(df.where("vec_id < 4"), df.where("vec_id < 4"), k=10).toPandas()
    assert len(few) == 12


def test_visits_are_never_broadcast(spark, monkeypatch):
    """Files of visits hold a query's vector once, so their size tells nothing of the batches that meet the pages."""
    joined = []
    monkeypatch.setattr(ann, "_scan", lambda k, turned, make=ann._scan: (joined.append(k), make(k, turned))[1])
    plan = ann.search(*(vectors(spark)[1].where(c) for c in ("true", "vec_id % 20 = 0")), k=10)._jdf.queryExecution().executedPlan().toString()
    assert len(joined) == 2
    for line in plan.splitlines():
        assert "q_vectors" not in line or "BroadcastExchange" not in line
    over = [line.split("Join", 1)[1] for line in plan.splitlines() if "HashJoin" in line or "MergeJoin" in line]
    assert sum("share" in x for x in over) == 1 and "SortMergeJoin" in plan


def test_rows_of_one_id_are_candidates_each(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(7, [100.0, 0.0]), (7, [100.0, 0.0]), (7, [50.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id in (3, 7)"), k=5, expected=1.0).toPandas()
    of = {q: list(zip(f.vec_id, f.score)) for q, f in got.sort_values("rank").groupby("query_id")}
    assert of[3] == [(7, 300.0), (7, 300.0), (7, 153.0), (19, 58.0), (18, 55.0)]
    assert of[7] == [(n, 7.0 * n + 1) for n in (19, 18, 17, 16, 15)]  # asked with the first of its vectors; rows of its id are its own


def recall(spark, x, k=20, **settings):
    """Of ``ann.search`` at its shipped settings, against brute force."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=k, **settings).toPandas()
    own = {q: set(f) for q, f in got.groupby("query_id")["vec_id"]}
    hit = n = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.argsort(-score, kind="stable")[:k]
        hit, n = hit + len(own[q] & set(want)), n + k
    return hit / n


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_without_structure(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.95


def varied(kind, n=3000, d=64):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(n, d))
    if kind in (1.0, 0.5, 0.25):
        return x * np.exp(kind * rnd.normal(size=(n, 1)))
    if kind == "one large":
        x[17] *= 1000
    if kind == "clustered":
        x = np.repeat(rnd.normal(size=(n // 50, d)), 50, axis=0) + 0.2 * x
        x *= np.exp(0.7 * rnd.normal(size=(n, 1)))
    return rnd.normal(size=(n, 4)) @ rnd.normal(size=(4, d)) if kind == "rank 4" else x


@pytest.mark.parametrize("kind", [1.0, 0.5, 0.25, "plain", "one large", "clustered", "rank 4"])
def test_recall_of_varied_norms(spark, kind, monkeypatch):
    seen = []
    monkeypatch.setattr(ann, "_pages", lambda placed, size, make=ann._pages: (seen.append((size, placed.count())), make(placed, size))[1])
    assert recall(spark, varied(kind)) >= 0.95
    visits = sum(n for size, n in seen if size == ann.BATCH)
    assert visits < 150 * int(ann.MORE * 3000**0.5) * (0.8 if kind in ("plain", "one large") else 0.6)  # one in 20 asks; not all lists


def test_structured_vectors_are_found_in_few_lists(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    x = np.repeat(rnd.normal(size=(40, 32)), 50, axis=0) + 0.3 * rnd.normal(size=(2000, 32))
    seen = []
    monkeypatch.setattr(ann, "_pages", lambda placed, size, make=ann._pages: (seen.append((size, placed.count())), make(placed, size))[1])
    assert recall(spark, x) >= 0.95
    visits = sum(n for size, n in seen if size == ann.BATCH)
    assert visits < 0.4 * 100 * int(ann.MORE * np.sqrt(2000))


def test_huge_and_tiny_components(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    for scale in (1e150, 1e-150):
        assert recall(spark, x * scale, k=5) >= 0.9


def test_vectors_of_each_size_are_compared(spark):
    rnd = np.random.default_rng(4)
    x = {d: rnd.normal(size=(40, d)) for d in (6, 9)}
    for v in x.values():
        v[10:20] = 2 * v[0]
    rows = [(100 * d + i, v.tolist()) for d in x for i, v in enumerate(x[d])] + [(5000, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    dup = {r.vec_id: r for r in embed_dedup.near_duplicates(df, 0.95).collect()}
    got = ann.search(df, df, k=5).toPandas()
    assert len(dup) == 81 and (dup[5000].n_links, dup[5000].kept) == (0, True) and set(got.query_id) == {i for i, _ in rows[:-1]}
    for d, v in x.items():
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        np.fill_diagonal(link, False)
        want = components(range(40), lambda i, j: link[i, j])
        assert all((dup[100 * d + i].n_links, dup[100 * d + i].component_id) == (link[i].sum(), 100 * d + want[i]) for i in range(40))
        score = v @ v.T
        np.fill_diagonal(score, -np.inf)
        best = {(100 * d + q, 100 * d + i) for q in range(40) for i in np.lexsort((np.arange(40), -score[q]))[:5]}
        own = set(map(tuple, got[["query_id", "vec_id"]].to_numpy().tolist()))
        assert len(best & own) >= 0.95 * len(best)


def test_rollups(spark, docs, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    change = "op string, doc_id long, source string, lang string, version string, n_tokens long"
    one = spark.createDataFrame([("upsert", 1, "a", "en", "v1", 5), ("upsert", 1, "a", "en", "v2", 4), ("upsert", 2, "a", None, "v1", 7), ("upsert", 3, None, "de", "v1", 1), ("upsert", 3, None, "de", "v1", 1), ("upsert", None, "z", "z", "v1", 9)], change)
    two = spark.createDataFrame([("upsert", 2, "b", "en", "v1", 6), ("delete", 3, None, None, None, None), ("delete", 99, None, None, None, None), ("delete", 1, None, None, None, None), ("upsert", 1, "a", "en", "v1", 8)], change)
    total = lambda: sorted((tuple(x) for x in r.totals().collect()), key=str)
    assert r.commit(1, one) and total() == sorted([("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 4), ("a", None, "v1", 1, 7), (None, "de", "v1", 1, 1)], key=str)
    assert r.commit(2, two) and not r.commit(2, two) and not r.commit(1, one)
    assert total() == sorted([("a", "en", "v1", 1, 8), ("b", "en", "v1", 1, 6)], key=str)
    with pytest.raises(ValueError):
        r.commit(0, one)
    before = total()
    r.compact()
    assert total() == before and r.commit(2, two) is False
    three = spark.createDataFrame([("upsert", 1, "a", "en", "v1", 9), ("delete", 2, None, None, None, None)], change)
    r.vacuum()
    assert r.commit(3, three) and total() == [("a", "en", "v1", 1, 9)]
    r.compact()
    r.compact()
    assert total() == [("a", "en", "v1", 1, 9)] and {(x.doc_id, x.n_tokens) for x in r.current(9).collect()} == {(1, 9)}
    own = fresh_tokenizer("byte_bpe_50k.json")
    first = {}
    for d in sorted(docs.collect(), key=lambda d: d.doc_id):
        first.setdefault(d.text or "", d)
    want = {}
    for t, d in first.items():
        n, s = want.get((d.source, d.lang), (0, 0))
        want[d.source, d.lang] = n + 1, s + len(own.encode(t, add_special_tokens=False).ids)
    assert {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in token_counts.maintained(docs).collect()} == want


def test_rollup_query_counts_every_document(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from tidewire.llm.queries import QUERIES

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        fresh = Tokenizer.from_file(tokens.public_path(f"{version}.json"))
        for d in {d.doc_id: d for d in docs.collect()}.values():
            n, s = want.get((d.source, d.lang, version), (0, 0))
            want[d.source, d.lang, version] = n + 1, s + len(fresh.encode(d.text or "", add_special_tokens=False).ids)
    got = QUERIES["op9_token_count_rollups"](spark, str(tmp_path)).collect()
    assert {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in got} == want and len(got) == len(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = documents(spark, 9, 200).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 5").union(spark.createDataFrame([(900, "call +1 (988) 555-2485 or a.b@c.org " + " ".join(WORDS), "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(150)] + [(i, 0) for i in (200, 201, 202, 203)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path)).persist()
        assert now.columns == docs.columns, name
        if name == "personal data":
            assert before.count() == now.count() and now.where("doc_id = 900").first().text.startswith("call [PHONE] or [EMAIL] ")
    last = P.STAGES[-1][1](spark, now, str(tmp_path)).toPandas()
    assert sorted(last[last["piece"] == 0].doc_id) == sorted(r.doc_id for r in now.collect())
    assert len(P.run(spark, str(tmp_path)).toPandas()) == len(last)
    assert isinstance(last, pd.DataFrame) and [n for n, _ in P.STAGES] == ["quality", "near-duplicates", "personal data", "mixture", "packing"]


def plain_pipeline(rows, labels):
    """The pipeline over (doc_id, text, source), one stage after another, in loops; by the model that the first stage fits."""
    of = lambda t: t or ""
    x = {i: quality.features(of(t)) for i, t, _ in rows}
    classes = [np.array([x[i] for i, _, _ in rows if labels.get(i) == c and zlib.crc32(str(i).encode()) % 5]) for c in (0, 1)]
    n = np.array([len(c) for c in classes])
    mean = [c.mean(axis=0) for c in classes]
    cov = [np.cov(c.T, bias=True) for c in classes]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    mixed = [(1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled for c in cov]
    cov = [(1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + quality.LEAST * np.eye(len(c)) for c in mixed]
    log = lambda v, c: np.log(n[c] / n.sum()) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * (v - mean[c]) @ np.linalg.inv(cov[c]) @ (v - mean[c])
    rows = [r for r in rows if 1 / (1 + np.exp(np.clip(log(x[r[0]], 0) - log(x[r[0]], 1), -500, 500))) >= quality.THRESHOLD]
    fp = {i: simhash.fingerprint(of(t)) for i, t, _ in rows}
    group = components(sorted(fp), lambda i, j: ((fp[i] ^ fp[j]) % 2**64).bit_count() <= 4)
    rows = [r for r in rows if group[r[0]] == r[0]]
    added, clean = plain_bootstrap([of(t) for _, t, _ in rows]), []
    for (i, t, source), more in zip(rows, added):
        out, at = "", 0
        for s, k, e in sorted(base_spans(of(t)) + [(s, k, e) for (s, e), k in more]):
            if s >= at:
                out += t[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        clean.append((i, out + of(t)[at:], source))
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(clean, columns=["doc_id", "text", "source"]))
    times = {r.doc_id: r.taken // r.size if r.size else 0 for r in c.execute(MIX_SQL).df().itertuples()}
    own, pieces = fresh_tokenizer("word_bpe_49k.json"), []
    for i, t, _ in clean:
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        pieces += [(i, s // 2048, s, len(p := ids[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for s in range(0, len(ids), 2048)] * times[i]
    return sorted(pieces)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(12)
    rows = [(i, t, rnd.choice("abc")) for i, t in enumerate(planted(3)[0])]
    rows += [(1000 + i, "!! ".join(rnd.choice(WORDS).upper() for _ in range(30)), "a") for i in range(60)]  # to be rejected
    long = " ".join(rnd.choice(WORDS) for _ in range(3000))
    rows += [(2000 + i, long + (" sail" if i % 2 else ""), "b") for i in range(12)] + [(3000, None, "c"), (3001, "", "a")]
    labels = {i: int(i < 1000) for i, _, _ in rows if i < 2000 and i % 2 == 0}
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).toPandas()
    want = plain_pipeline(rows, labels)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(want) > 100
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum()[:-1]] and x["length"].sum() <= 2048


def test_stages_on_empty_tables_and_clashing_names(spark, empty, labels, tmp_path):
    import corpus_pipeline as P

    assert simhash.keep_one(empty).count() == pii.redact(empty).count() == quality.keep_good(empty, labels).count() == 0
    assert token_counts.maintained(empty).count() == token_counts.restored(empty).count() == 0
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    names = ["id", "row", "x", "fp", "h", "base", "seen", "spans", "done", "may", "may_go", "low", "group", "first", "_row", "_times", "_source", "rest", "edge", "times", "place"]
    odd = spark.createDataFrame([(i, f"call a{i}@b.c {w} " * 9, "s", *names) for i, w in enumerate(WORDS)], ", ".join(["doc_id long, text string, source string", *(f"{n} string" for n in names)]))
    for out in (simhash.keep_one(odd), pii.redact(odd), quality.keep_good(odd, labels), mixing.repeat(odd)):
        assert out.columns == odd.columns and all(r[n] == n for r in out.collect() for n in names)
    assert simhash.near_duplicates(odd).count() == pii.find(odd).count() == mixing.mix(odd).count() == len(WORDS)


def test_tables_of_a_pipeline_go(spark):
    from tidewire.llm import common

    with common.scratch(spark) as keep:
        inner = common.materialise(spark.range(5), "inner")
        kept = keep(inner, "kept")
    assert kept.count() == 5 and not spark._jvm.java.io.File(inner._tidewire_path.removeprefix("file://")).exists()
    common.drop_table(kept)
    assert not spark._jvm.java.io.File(kept._tidewire_path.removeprefix("file://")).exists()


def test_large_classes_are_joined_where_their_rows_are(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as fp")
    classes = rows.groupBy("fp").count().withColumnRenamed("count", "times")
    from tidewire.llm.common import join_classes

    got = join_classes(rows, classes, "fp").collect()
    assert len(got) == 3000 and all(r.times == (1000 if r.fp == -1 else 1) for r in got)


def test_rows_without_ids_stay(spark):
    text = " ".join(WORDS)
    rows = [(1, text), (None, text), (None, "alone here with other words entirely"), (4, "z y x w v u t s"), (4, "z y x w v u t s")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    assert sorted(map(str, simhash.keep_one(df).collect())) == sorted(map(str, [df.collect()[k] for k in (0, 2, 3)]))


def test_rows_of_one_id_with_differing_texts_stay_by_their_groups(spark):
    text, alone, other = " ".join(WORDS), "alone here with other words entirely", "z y x w v u t s"
    rows = [(1, text), (4, alone), (4, text), (4, alone), (4, other)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(1)
        assert sorted(map(tuple, simhash.keep_one(df).collect())) == sorted([(1, text), (4, alone), (4, other)])


def test_toxicity_learns_from_the_documents_that_are_there(spark, monkeypatch):
    rows = [(i, " ".join(["zorg" if i % 2 else "foam", *WORDS])) for i in range(60)]
    df = spark.createDataFrame(rows + rows * 3, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, grade, n: given.append(len(rows)))
    toxicity.train(df, lab, sample=40)
    toxicity.train(df, lab, sample=100)
    assert given == [40, 60]
    size = max(len(toxicity.features(t)[0]) for _, t in rows)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 10 * size)
    toxicity.train(df, lab, sample=100)
    assert 10 <= given[-1] <= 11


def test_grades_and_chunks_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    rnd = np.random.default_rng(2)
    toxic = (rnd.random(300) < 0.4).astype(int)
    vectors = []
    for y in toxic:
        f = np.sort(rnd.choice(40, rnd.integers(0, 9), replace=False))
        f = f[(f < 30) | (y == 1) | (rnd.random(len(f)) < 0.02)]  # features from 30 on are telling
        vectors.append((f, 1 + np.log(rnd.integers(1, 4, len(f)))))
    has = [[sum(k in f for (f, _), y in zip(vectors, toxic) if y == c) for k in range(40)] for c in (0, 1)]
    n = [int((toxic == c).sum()) for c in (0, 1)]
    telling = {k for k in range(40) if has[1][k] >= toxicity.OFTEN and ((has[1][k] + 0.5) / (n[1] + 1)) / ((has[0][k] + 0.5) / (n[0] + 1)) >= toxicity.TELLING}
    count = [sum(round(np.exp(x - 1)) for k, x in zip(*v) if k in telling) for v in vectors]
    edges = np.quantile([c for c, y in zip(count, toxic) if y], np.arange(1, toxicity.GRADES) / toxicity.GRADES)
    want = [1 + int((edges < c).sum()) if y else 0 for c, y in zip(count, toxic)]
    assert telling and len(set(want)) > 2
    for chunk in (1, 7, 10_000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        rows = toxicity.rows_of(vectors)
        parts = list(rows.chunks())
        assert [i for part, *_ in parts for i in range(part.start, part.stop)] == list(range(300))
        assert [(int(k), part.start + int(d)) for part, at, _, doc in parts for k, d in zip(at, doc)] == [(int(k), i) for i, (f, _) in enumerate(vectors) for k in f]
        assert toxicity.grades(rows, toxic).tolist() == want
