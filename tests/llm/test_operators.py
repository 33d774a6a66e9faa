"""Edge cases of every corpus operator, and brute-force versions of those that SQL can't express."""

import math
import re
import time
import types
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumengrid.llm import common, decontaminate, language, line_dedup, mixing, mixing_lm, quality, quality_rules, registry, secrets, simhash, toxicity

LONG = "lorem ipsum dolor sit amet " * 4000
COPY = "one line that two documents share\nand another one of them\nshort"
EDGE = [(1, COPY), (2, COPY), (2, COPY), (3, None), (4, ""), (5, "   \n\t\n"), (None, COPY), (None, None), (6, LONG), (7, "token = abcdefgh1234 É"), (8, "ß" * 30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_lines int, n_words int, score int, p int, row int, _id int, key int, label int, bins int"
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 2}", *[k] * 9) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "and another one"), (2, None), (3, "  "), (10, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")], "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda d, y, b: line_dedup.line_dedup(d),
    "decontaminate": lambda d, y, b: decontaminate.decontaminate(d, b),
    "quality_rules": lambda d, y, b: quality_rules.quality_rules(d),
    "simhash": lambda d, y, b: simhash.near_duplicates(d),
    "toxicity": lambda d, y, b: toxicity.toxicity(d, y),
    "quality": lambda d, y, b: quality.quality(d, y),
    "mixing_lm": lambda d, y, b: mixing_lm.lm_scores(d),
    "language": lambda d, y, b: language.language(d),
    "secrets": lambda d, y, b: secrets.scan(d)[0],
    "mixing": lambda d, y, b: mixing.mix(d, mixing.domains(y)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edge_rows_and_empty_tables(name, docs, labels, items):
    assert OPERATORS[name](docs, labels, items).count() == len(EDGE)
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    key = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(want.columns) == sorted(got.columns) and key(want) == key(got)


def test_line_dedup_keeps_the_first(docs):
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs.where("doc_id <= 4 OR doc_id IS NULL")).collect()}
    assert got[1, COPY] == (3, 0) and got[2, "short"] == (3, 2) and got[None, "short"] == (3, 2) and got[3, ""] == (1, 0)


def test_bloom_filters_hold_every_repeat(spark):
    import xxhash

    texts = [(i, f"line number {i % 50} of some text\nown line of document {i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    bits = line_dedup.filter_bits(docs)
    packed = line_dedup.twice_seen(docs, 10, bits)
    held = lambda s: line_dedup.holds(packed, line_dedup.positions(np.array([xxhash.xxh64_intdigest(s.encode())], np.uint64), bits))[0]
    assert all(held(f"line number {i} of some text") for i in range(50))
    assert sum(held(f"own line of document {i}") for i in range(200)) < 20


def test_line_dedup_beyond_one_filter(spark, docs):
    """Filters of single hash ranges give what one filter gives."""
    texts = [(i if i % 9 else None, f"line number {i % 50} of some text\nown line of document {i}\nline that all have") for i in range(400)]
    many = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    few = docs.select("doc_id", "text")
    for d in (many, few):
        one, ranges = ({tuple(map(str, r)) for r in line_dedup.line_dedup(d, most_bits=b).collect()} for b in (29, 9))
        assert one == ranges
    assert sum(r.n_dropped for r in line_dedup.line_dedup(many, most_bits=9).collect()) > 700


def places_by_brute_force(docs, items, size, slack):
    """Hit words, items and near items of each text, from the words alone."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    words = {i: cut(t) for i, t in docs}
    n = Counter(w for ws in words.values() for w in ws)
    windows = {}
    for item, t in items:
        ws = cut(t)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + size]), set()).add(item)
    out = {}
    for i, ws in words.items():
        hit, found, near = set(), set(), set()
        for window, own in windows.items():
            k = len(window)
            at = [j for j in range(len(ws) - k + 1) if tuple(ws[j : j + k]) == window]
            hit |= {j + x for j in at for x in range(k)}
            found |= own if at else set()
            rare = sorted(range(k), key=lambda x: (n[window[x]], x))[:2]
            lists = [[j - x for j, w in enumerate(ws) if w == window[x]] for x in rare]
            if lists[0] and (len(rare) == 1 or any(abs(a - b) <= slack for a in lists[0] for b in lists[1])):
                near |= own
        out[i] = (len(ws), len(hit), sorted(map(str, found)), len(near))
    return out


@pytest.mark.parametrize("limit", [decontaminate.SMALL_ROWS, 0])
def test_decontamination_matches_brute_force(spark, limit):
    """Exact and proximity matches; with a limit of 0 rows no table is broadcast."""
    rng = np.random.default_rng(8)
    item = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (3, 9, 10, 14, 30)]
    items = [(i, t) for i, t in enumerate(item)] + [(7, item[2]), (8, None), (9, "!!")]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 80)) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(20 + i, f"{texts[i]} {t}. {t}") for i, t in enumerate(item)]
    docs += [(40 + i, f"{texts[i]} {t.replace(' ', ' stray ', 3)}") for i, t in enumerate(item)] + [(60, None), (61, ""), (62, item[2].upper())]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if limit == 0 else 10485760)
    try:
        got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.n_near) for r in got} == places_by_brute_force(docs, items, 10, 5)
    assert any(r.n_near > len(r.item_ids) for r in got)


def test_decontamination_with_one_item_in_all_documents(spark):
    """A window that all items and all documents have."""
    common = " ".join(f"c{i}" for i in range(10))
    docs = spark.createDataFrame([(i if i % 3 else None, f"{common} own{i}") for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"x{i} {common}") for i in range(60)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert len(got) == 200 and all((r.n_hit, len(r.item_ids), r.n_near) == (10, 60, 60) for r in got)


def plain_fingerprint(text):
    """A fingerprint bit by bit, as the contract words it."""
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    pieces = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(40)]
    texts = base + [t.replace("w1", "v1", 1) for t in base] + [" ".join(t.split()[:-1]) for t in base] + base[:5] + ["", None, "one two"]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    assert [got[i][0] for i in range(len(texts))] == prints.view(np.int64).tolist()
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)) for i in range(len(texts))]
    assert [got[i][1] for i in range(len(texts))] == root


def test_simhash_splits_large_nodes(spark):
    rng = np.random.default_rng(4)
    near = (np.uint64(0x123456789ABCDEF0) ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(400)], np.uint64)).view(np.int64)
    nodes = spark.createDataFrame([(int(f), int(f)) for f in set(near.tolist())], "fp long, node long")
    for node_rows in (8192, 20):
        links = {(r.a, r.b) for r in simhash.near_links(nodes, 3, node_rows).collect()}
        root = {int(f): int(f) for f in set(near.tolist())}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            assert a in root and b in root
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        values = np.array(sorted(root), np.int64)
        for f in values:
            for g in values[np.bitwise_count(values.view(np.uint64) ^ np.int64(f).view(np.uint64)) <= 3]:
                assert find(int(f)) == find(int(g))


def test_maximal_segments():
    assert [(s, e, round(x, 6)) for s, e, x in toxicity.maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0]))] == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]


def test_secrets_match_plain_patterns(spark):
    """All spans by Python's re, in a text of many matches, copies of texts and repeated rows."""
    many = " ".join(f"token = abcdefg{i:05d}! {'0123456789abcdef' * 2} \u00e9AKIA{i:012d}" for i in range(3000))
    rows = [(1, many), (2, many), (2, many), (3, "password: short"), (3, "SECRET=longenough1"), (4, None), (None, "api_key='abcdefgh12'")]
    want = []
    for i, t in rows:
        found = []
        for rank, rule in enumerate(secrets.RULES):
            found += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, t or "") if len(m.group(rule.group)) >= rule.least]
        want.append((str(i), sorted(found)))
    out, _ = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [(str(r.doc_id), [(x.start, x.rank, x.kind, x.end) for x in r.spans]) for r in out.collect()]
    assert sorted(got) == sorted(want) and len(got[0][1]) in (0, 1, 9000)


def test_secret_ledger_scans_only_new_pairs(docs):
    first, ledger = secrets.scan(docs.where("doc_id <= 6"))
    again, added = secrets.scan(docs, ledger=ledger)
    texts = {t or "" for i, t in EDGE}
    old = {t or "" for i, t in EDGE if i is not None and i <= 6}
    assert added.select("blob").distinct().count() == len(texts - old)
    assert again.count() == len(EDGE) and [x.kind for x in again.where("doc_id = 7").first().spans] == ["assign"]


def test_lm_base_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    below = math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    got = {r.doc_id: r for r in mixing_lm.lm_scores(docs, head_words=500).collect()}
    for i, ws in rows:
        want = sum(math.log10(c[w] + 0.1) - below for w in [*ws, None])
        assert math.isclose(got[i].base_score, want, abs_tol=1e-6) and got[i].held_out == held(i) and got[i].n_tokens == len(ws) + 1
        assert got[i].n_known == sum(c[w] > 0 for w in [*ws, None]) and got[i].score < 0


def plain_bits(m, text):
    """Bits of a text, one decision after the other."""
    code, own, bits_each = m["code"], np.zeros(mixing_lm.INPUTS), []
    data = mixing_lm.PAD + text
    last, run, pending, done, block = {}, 0, np.zeros(mixing_lm.INPUTS), 0, 0
    slot = lambda h, salt: int(mixing_lm.slots(np.array([h % 2**64], np.uint64), salt, m["bits"])[0])
    word, place = 0, 0
    for i in range(len(mixing_lm.PAD), len(data)):
        at = i - len(mixing_lm.PAD)
        if at and mixing_lm.BLOCK_OF[at] != block:
            own, pending, done, block = own + pending * mixing_lm.TEXT_RATE / (1 + done / 512), np.zeros(mixing_lm.INPUTS), 0, mixing_lm.BLOCK_OF[at]
        if data[i - 1] == 32:
            word, place = 0, 0
        six = data[i - 6 : i]
        guess = data[last[six]] if six in last else None
        trust = 0 if guess is None else 1 + (run > 3) + (run > 15)
        slots = [slot(word, 1), slot(int.from_bytes(data[i - 5 : i], "little"), 3)]
        pair = data[i - 1] | (data[i - 2] << 8)
        row = int(code.context[pair]) * 256
        path = lambda c: code.step[code.start[row + c] :][: code.length[row + c]].tolist()
        root = int(m["places"][2 * mixing_lm.ROOT])
        gate = trust * 16 + sum((int(m["tables"][k][slots[k] ^ root]) & 3) << (2 - 2 * k) for k in range(2))
        mine, theirs, total = path(data[i]), path(guess) if guess is not None else [], 0.0
        for j, step in enumerate(mine):
            y = step & 1
            entries = [int(m["tables"][k][slots[k] ^ int(m["places"][step])]) for k in range(2)]
            x = [(e >> 2) / 4 for e in entries]
            x.append(0.0 if theirs[:j] != mine[:j] or j >= len(theirs) else 2.0 if theirs[j] & 1 else -2.0)
            mix = min(11.5, max(-11.5, sum((float(m["weights"][k][gate]) + own[k]) * x[k] for k in range(3))))
            p = 1 / (1 + math.exp(-mix))
            q = (p + float(m["map"][gate * mixing_lm.BINS + int(mixing_lm.cell(np.array([mix], np.float32))[0])])) / 2
            total -= math.log2(min(1 - 2e-5, max(2e-5, q if y else 1 - q)))
            pending, done = pending + np.array(x) * (y - p), done + 1
        run = run + 1 if guess == data[i] else 0
        last[six] = i
        word = (word + int(mixing_lm.RANDOM[data[i] + 256 * (place & 31)])) % 2**64
        place += 1
        bits_each.append(total)
    return bits_each


def plain_phrases(words, costs):
    """(beginning, rest, bits) of the phrases of a text."""
    out, held = [], []
    for w, c in zip(words, costs, strict=True):
        held.append((w, c))
        h = 0 if w == mixing_lm.END_WORD else sum(int(mixing_lm.RANDOM[b + 256 * (k & 31)]) for k, b in enumerate(w)) % 2**64
        if (h * mixing_lm.M % 2**64 >> 33) % mixing_lm.PHRASE == 0 or w == mixing_lm.END_WORD:
            if len(held) > 3:
                out.append((tuple(x for x, _ in held[:3]), tuple(x for x, _ in held[3:]), sum(c for _, c in held[3:])))
            held = []
    return out


def test_lm_scores_match_a_plain_coder(spark):
    """Scores of 60 texts, some of them copies, by a coder that takes one decision at a time and keeps phrases in a dictionary."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{'abcdefgh'[x % 8]}{x * x}" for x in rng.zipf(1.5, n) % 300)
    rows = [(i, text(int(rng.integers(0, 120)))) for i in range(55)]
    rows += [(100 + i, rows[5 * i][1]) for i in range(4)] + [(200, None), (201, rows[3][1] + " " + rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = mixing_lm.counted(docs, 10, 0)
    m = mixing_lm.fit(*counted)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain, leads, rests = {}, Counter(), Counter()
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), mixing_lm.END_WORD]
        each = plain_bits(m, b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words])
        costs = [sum(each[e - len(w) - 1 : e]) for w, e in zip(words, ends, strict=True)]
        plain[i] = (sum(each), plain_phrases(words, costs))
        if not held(i):
            leads.update(a for a, *_ in plain[i][1])
            rests.update((a, r) for a, r, _ in plain[i][1])
    got = {r.doc_id: r for r in mixing_lm.lm_scores(docs).collect()}
    gained = 0
    for i, (bits, phrases) in plain.items():
        own_lead, own_rest = Counter(a for a, *_ in phrases), Counter((a, r) for a, r, _ in phrases)
        for a, r, c in phrases:
            n_lead, n_rest = (leads[a], rests[a, r]) if held(i) else (leads[a] - own_lead[a], rests[a, r] - own_rest[a, r])
            new = -math.log2((n_rest + 2.0**-c) / (n_lead + 1))
            gained += new < c - 5
            bits += new - c
        assert math.isclose(got[i].score, -bits * math.log10(2), rel_tol=2e-3), i
    assert gained > 5  # copies were foreseen


def plain_decisions(m, tables, text):
    """(gate, inputs of both tables and the match in quarters, decision) of a text, one decision after the other."""
    code, data, last, run, word, place, out = m["code"], mixing_lm.PAD + text, {}, 0, 0, 0, Counter()
    slot = lambda h, salt: int(mixing_lm.slots(np.array([h % 2**64], np.uint64), salt, m["bits"])[0])
    for i in range(len(mixing_lm.PAD), len(data)):
        if data[i - 1] == 32:
            word, place = 0, 0
        six = data[i - 6 : i]
        guess = data[last[six]] if six in last else None
        lines = [slot(word, 1), slot(int.from_bytes(data[i - 5 : i], "little"), 3)]
        row = int(code.context[data[i - 1] | (data[i - 2] << 8)]) * 256
        path = lambda c: code.step[code.start[row + c] :][: code.length[row + c]].tolist()
        entry = lambda k, step: int(tables[k][lines[k] ^ int(m["places"][step])])
        gate = (0 if guess is None else 1 + (run > 3) + (run > 15)) * 16 + sum((entry(k, 2 * mixing_lm.ROOT) & 3) << (2 - 2 * k) for k in range(2))
        mine, theirs = path(data[i]), path(guess) if guess is not None else []
        for j, step in enumerate(mine):
            match = 0 if theirs[:j] != mine[:j] or j >= len(theirs) else 8 if theirs[j] & 1 else -8
            out[gate, entry(0, step) >> 2, entry(1, step) >> 2, match, step & 1] += 1
        run, last[six] = run + 1 if guess == data[i] else 0, i
        word, place = (word + int(mixing_lm.RANDOM[data[i] + 256 * (place & 31)])) % 2**64, place + 1
    return out


def test_lm_all_documents_teach_the_weights(spark):
    """Each decision of each document to learn from is counted, by the other half's tables, and the weights are where its gradient is none."""
    rng = np.random.default_rng(13)
    docs = spark.createDataFrame([(i, " ".join(f"w{x * x}" for x in rng.zipf(1.6, 40) % 50)) for i in range(50)] + [(60, None), (None, "an id of none")], "doc_id long, text string").repartition(3)
    rows, words, total = mixing_lm.counted(docs, 10, 0)
    m = mixing_lm.fit(rows, words, total)
    m["halves"] = [m["tables"], [np.random.default_rng(k).permutation(t) for k, t in enumerate(m["tables"])]]
    texts, want = rows.where("learned").select("text", "half"), Counter()
    assert {r.half for r in texts.collect()} == {0, 1}
    for r in texts.collect():
        want.update(plain_decisions(m, m["halves"][1 - r.half], b" ".join([*bytes(r.text).lower().split(), mixing_lm.END_WORD])))
    got, seen = Counter(), np.zeros((mixing_lm.GATES, mixing_lm.CELLS), np.int64)
    for r in texts.mapInArrow(mixing_lm._decided(spark.sparkContext.broadcast(m)), "gate int, counts binary").collect():
        seen[r.gate] += mixing_lm._unpacked(bytes(r.counts), mixing_lm.CELLS)
    for gate, at in zip(*np.nonzero(seen), strict=True):
        cell, y = divmod(int(at), 2)
        got[int(gate), cell // 189 - 31, cell // 3 % 63 - 31, 8 * (cell % 3 - 1), y] = int(seen[gate, at])
    assert got == want
    weights, chances = mixing_lm.mixer(texts, m, 2)
    for gate in {g for g, *_ in want}:
        w, pull = weights[:, gate].astype(float), np.zeros(3)
        for (g, *x, y), n in want.items():
            if g == gate:
                pull += n * np.array(x) / 4 * (y - 1 / (1 + math.exp(-(w @ np.array(x)) / 4)))
        assert np.allclose(pull, mixing_lm.HELD * (w - mixing_lm.FIRST_WEIGHT), atol=0.2)
    assert ((chances > 0) & (chances < 1)).all()


def test_lm_kinds_come_in_the_order_of_their_places():
    """Each kind once (or, if hashes are alike in most bits, more often), with all its bytes counted."""
    rng = np.random.default_rng(24)
    b, guess, trust = (rng.integers(0, k, 5000).astype(np.int64) for k in (4, 4, 3))
    window, word = (rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(k) for k in (30, 0))
    of, times = mixing_lm.kinds(b, window, word, guess, trust)
    assert (np.diff(of) > 0).all() and times.sum() == 5000
    own = lambda i: (b[i], window[i], word[i], guess[i] * (trust[i] > 0), trust[i])
    got = Counter()
    for i, n in zip(of, times, strict=True):
        got[own(i)] += n
    assert got == Counter(map(own, range(5000)))


def test_lm_words_are_counted_as_python_splits_them():
    """Each white space, blank and long texts, either half, and counts given out in between."""
    texts = [b"", b" \t\n\x0b\x0c\r ", b"A  b\r\n\ta \x1c \xc3\x84\xc3\xa4", b"Z" * 3000 + b" [@`{ z", b"a " * 5000] + [b"w%d  A" % (i % 40) for i in range(600)]
    for t in texts:
        assert mixing_lm.normal(t) == b" ".join([*t.lower().split(), mixing_lm.END_WORD])
    halves = [i % 3 % 2 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(halves, pa.int32())], ["text", "half"])
    for flush in (10, 1000):
        got = [Counter(), Counter()]
        for out in mixing_lm._counted(flush)(iter([batch])):
            assert out.schema.names == ["word", "n", "n_second"] and out.num_rows <= max(flush, 50)
            for w, n, k in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[0][w], got[1][w] = got[0][w] + n, got[1][w] + k
        for half, of in enumerate((texts, [t for t, h in zip(texts, halves, strict=True) if h])):
            assert +got[half] == Counter(w for t in of for w in [*t.lower().split(), mixing_lm.END_WORD])
    assert list(mixing_lm._counted()(iter([]))) == []


def test_lm_packs_few_bytes_of_small_counts():
    """Counts come back as they were, up to the largest."""
    for x in (np.zeros(50, np.int64), np.arange(300, dtype=np.int32), np.array([0, 255, 256, 1 << 40, (1 << 63) - 1])):
        assert mixing_lm._unpacked(mixing_lm._packed(x), len(x)).tolist() == x.tolist()


def test_lm_counts_beyond_24_bits():
    """Counts of common words in the tables have no limit."""
    code = mixing_lm.Code({(32 << 8) + 32: np.ones(256, np.int64)})
    batch = pa.RecordBatch.from_arrays([pa.array([b"the"]), pa.array([1 << 40]), pa.array([3])], ["word", "n", "n_second"])
    made = [r.to_pylist()[0] for r in mixing_lm._fill_words(types.SimpleNamespace(value=code), 16)(iter([batch]))]
    assert {r["half"]: int(mixing_lm._unpacked(r["counts"], 2 << 16).max()) for r in made} == {0: 1 << 40, 1: 3}


def test_lm_does_not_depend_on_the_head_or_on_dealing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    one, two = ({r.doc_id: r for r in mixing_lm.lm_scores(d, head_words=h).collect()} for d, h in ((docs.repartition(2), 100), (docs.repartition(7), 1 << 17)))
    assert all(math.isclose(one[i].score, two[i].score, rel_tol=1e-4) and math.isclose(one[i].base_score, two[i].base_score, rel_tol=1e-9) for i in one)


def test_lm_learns_nothing_from_held_out_rows(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, f"the word w{i % 7} and x{i % 3} again") for i in range(60)]
    hidden = [next(i for i in range(1000, 2000) if held(i))]
    score = lambda extra: {r.doc_id: r.score for r in mixing_lm.lm_scores(spark.createDataFrame(rows + extra, "doc_id long, text string"), head_words=12).collect()}
    once, again = score([(hidden[0], "q" * 3000)]), score([(hidden[0], "other words of it")])
    assert all(math.isclose(once[i], again[i], rel_tol=1e-5) for i, *_ in rows)


def test_lm_sees_whole_long_texts(spark):
    """Texts beyond a segment: a change at their end changes their score, and a copy of what came before costs little."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("".join("abcdefghij"[x] for x in rng.integers(0, 10, 6)) for _ in range(n))
    a, b = words(30_000), words(10)
    docs = spark.createDataFrame([(1, a), (2, a + " " + b), (3, " ".join([b] * 8000))], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing_lm.lm_scores(docs).collect()}
    assert got[1].score > got[2].score and got[3].bits_per_byte < 0.2 * got[1].bits_per_byte


def test_lm_beats_its_base_on_held_out_rows(spark, sf):
    # the base gives every unseen word the same probability and so is no distribution; with few words that favours it
    got = [r for r in registry.QUERIES["op7_mixing_lm"](spark, sf.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_classifiers_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()}
    q = [r for r in registry.QUERIES["op6_quality"](spark, sf).collect() if r.held_out and truth[r.doc_id].quality is not None]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in q]) > 0.95
    lang = [r for r in registry.QUERIES["op8_language"](spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in lang]) > 0.95


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [(truth[r.doc_id], r.predicted) for r in registry.QUERIES["op5_toxicity"](spark, sf).where("held_out").collect() if r.doc_id in truth]
    assert np.mean([p for y, p in rows if y]) >= 0.9 and np.mean([p for y, p in rows if not y]) < 0.01


def test_mixing_meets_targets(spark):
    rows = [(i, ("good words in a line " if i % 4 else "bad!! BAD!! ### ") * (3 + i % 5)) for i in range(200)]
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(100)], "doc_id long, domain string")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labelled, {"a": 0.5, "b": 0.5}).collect()
    total = sum(r.n_words for r in out)
    for k in range(2):
        assert abs(sum(r.p[k] * r.n_words * r.rate for r in out) / total - 0.5) < 0.01
    # the same fit by projected gradient over single documents
    p, n, r = np.array([x.p for x in out]), np.array([x.n_words for x in out]) / total, np.ones(len(out))
    weight = 1 / np.maximum(1e-2, n @ p)
    for _ in range(400):
        r = np.maximum(0, r - (p @ (((n * r) @ p - 0.5) * weight) + mixing.PULL * (r - 1)) / (1 + mixing.PULL))
    assert np.abs(r - [x.rate for x in out]).max() < 0.05


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # each stage on what the one before kept, against versions of its own
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in quality.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(i for i, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY)
    lined = stages["line dedup"](spark, good, sf)
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    texts, holders = {r.doc_id: (r.text or "").split("\n") for r in good.collect()}, {}
    for i, lines in texts.items():
        for line in lines:
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and i != min(holders[key(line)])
    want = {i: "\n".join(x for x in lines if not gone(i, x)) for i, lines in texts.items()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    apart = stages["SimHash near-dedup"](spark, lined, sf)
    assert sorted(str(r.doc_id) for r in apart.collect()) == plain_pipeline_groups(list(want.items()))
    kept = stages["benchmark decontamination"](spark, apart, sf)
    hit = {r.doc_id for r in decontaminate.decontaminate(apart, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in apart.collect()} - hit
    assert kept.columns == corpus_pipeline.COLUMNS
    assert 0 < corpus_pipeline.run(spark, sf).where(F.col("copies") > 0).count() <= docs.count()


def test_pipeline_drops_lightly_edited_rows(spark):
    import corpus_pipeline

    near = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    rows, wanted = [], 0
    for g in range(40):
        w = [f"w{g}x{i}" for i in range(300)]
        edited = [x + "e" if i in (40, 120, 200, 280) else x for i, x in enumerate(w)]  # 20 of 296 pieces differ: 0.87 are shared
        other = [x + "o" if i % 30 == 7 else x for i, x in enumerate(w)]  # 50 of 296: 0.71
        rows += [(10 * g, " ".join(w)), (10 * g, " ".join(w)), (10 * g + 1, " ".join(edited)), (None, " ".join(edited)), (10 * g + 2, " ".join(other))]
        wanted += 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sum(bin(simhash.fingerprint(rows[k][1]) ^ simhash.fingerprint(rows[k + 2][1])).count("1") > simhash.MOST_BITS for k in range(0, 200, 5)) > 0
    got = sorted(r.doc_id for r in near(spark, docs, "").collect())
    assert got == sorted(10 * g + k for g in range(40) for k in (0, 2)) and len(got) == wanted


def test_toxicity_learns_from_texts_that_begin_alike(spark):
    header = "this licence line of well over sixty characters opens every text of the source "
    docs = spark.createDataFrame([(i, header + (f"vile abuse{i}" if i % 2 else f"kind praise{i}")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert "vile$" in toxicity.fit(docs, labels)["entries"]
    copies = docs.withColumn("text", F.lit(header + "vile abuse"))
    assert "vile$" not in toxicity.fit(copies, labels)["entries"]  # equal texts count once


def test_toxicity_does_not_depend_on_dealing(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(n), labels).collect()} for n in (3, 7))
    assert one == two


def test_language_letters():
    assert [language.has_letter(t) for t in ("½", "²³", "Ⅷ", "_1", "", "Ⅷx", "ß", "中", "1a")] == [False] * 5 + [True] * 4


def test_lines_are_stripped_of_all_blanks(spark):
    rows = [(i, f"{a}same line of the host here{b}\nown {'abcde'[i]} text") for i, (a, b) in enumerate([("", "\r"), ("\t", ""), (" ", " "), ("", ""), ("\x0b", "\x0c")])]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    assert [r.removed_words for r in quality_rules.quality_rules(docs).collect()] == [6] * 5


def test_mixing_posteriors_on_held_out_labels(spark, sf):
    """Labels of a quarter of the documents are hidden: most of the toxic ones among them are found, and few others."""
    sf = sf.replace("sf0.001", "sf0.1")
    labelled = mixing.domains(spark.read.parquet(f"{sf}/labels.parquet")).cache()
    truth = {r.doc_id: r.domain for r in labelled.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1).collect()}
    seen = labelled.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 1)
    out = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), seen)
    names = list(mixing.TARGETS)
    got = [(truth[r.doc_id], names[int(np.argmax(r.p))]) for r in out.select("doc_id", "p").collect() if r.doc_id in truth]
    recall = {d: np.mean([g == d for y, g in got if y == d]) for d in names}
    assert recall["toxic"] >= 0.9 and recall["clean"] > 0.95 and recall["low"] > 0.9, recall


def test_naive_bayes_matches_plain_counts(spark):
    rows = [(i, [i % 3, (i * 7) % 5, *[0] * 9]) for i in range(60)]
    labelled = [(i, "a" if i % 3 else "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, bins array<int>")
    got = frame.select("doc_id", mixing.classifier(frame, spark.createDataFrame(labelled, "doc_id long, domain string"), ["a", "b", "c"]).alias("p")).collect()
    bins, y = dict(rows), dict(labelled)
    for r in got:
        logs = []
        for d in "abc":
            own = [bins[i] for i in y if y[i] == d]
            logs.append(math.log((len(own) + 1) / (len(y) + 3)) + sum(math.log((sum(b[f] == bins[r.doc_id][f] for b in own) + 0.5) / (len(own) + 0.5 * mixing.BINS)) for f in range(11)))
        want = np.exp(np.array(logs) - max(logs))
        assert np.allclose(r.p, want / want.sum(), atol=2e-6)


def plain_pipeline_groups(rows):
    """Rows that stay when of each group of near copies (0.8 of five-word pieces) the smallest id does."""
    pieces = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split())
    sets, root = [pieces(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i])
    return sorted(str(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]) for g in out.values())


def test_near_dedup_stage_matches_brute_force(spark):
    """Ids that are null or have several texts; equal rows; blank texts; extra columns with the names used inside."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(12)]
    edited = [" ".join(x if k != 50 else x + "e" for k, x in enumerate(t.split())) for t in base]
    rows = [(i, t) for i, t in enumerate(base)] + [(i + 1, t) for i, t in enumerate(edited[:6])] + [(3, base[9] + " own end"), (None, edited[7]), (None, "quite another text of its own with some words"), (None, None), (30, ""), (31, "  "), (5, base[5]), (5, base[5])]
    cols = "doc_id long, text string, lang string, source string, n_chars long, node long, _row long, first int"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3) for i, t in rows], cols)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in got.collect()) == plain_pipeline_groups(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_near_dedup_does_not_depend_on_its_limits(spark):
    """Chains of edits in families of similar texts: whatever a row is linked to first, the groups are the same."""
    from lumengrid.llm import near_copies

    rng = np.random.default_rng(12)
    rows = []
    for g in range(6):
        w = [f"g{g}w{x}" for x in rng.integers(0, 400, 150)]
        for i in range(40):  # each differs from the one before by a word, and from the family's first by ever more
            if i % 10 == 0:
                w = [x if k % 12 else f"{x}v{i}" for k, x in enumerate(w)]  # too different: a group of its own
            w[int(rng.integers(0, 150))] += "e"
            rows.append((100 * g + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {limits: sorted(str(r.doc_id) for r in near_copies.one_of_each(docs, *limits).collect()) for limits in ((4, 1024, 2048), (1, 8, 7), (200, 1024, 2048))}
    assert got[4, 1024, 2048] == got[1, 8, 7] == got[200, 1024, 2048] == plain_pipeline_groups(rows)


def test_near_dedup_loses_no_link_that_masks_dont_meet(spark, monkeypatch):
    """Pairs that share little over 0.8, of which masks bring some 94 % together, beside a passage of many texts."""
    from lumengrid.llm import near_copies

    rng = np.random.default_rng(21)
    passage, rows = [f"p{x}" for x in range(30)], []
    for g in range(200):
        w = [f"w{x}" for x in rng.integers(0, 100_000, 100)] if g % 2 else passage + [f"w{x}" for x in rng.integers(0, 100_000, 70)]
        v = list(w)
        for k in (40, 70):  # ten of 96 pieces
            v[k] += "e"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), list(range(0, 400, 2))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == want
    monkeypatch.setattr(near_copies, "MOST_OFTEN", 3)  # of the passage's pieces, which are marks of 200 texts
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs, 1, 8, 7, often=4).collect()) == want


def test_near_dedup_shuffles_texts_of_pairs_to_confirm_only(spark, monkeypatch):
    """400 texts of random words, a few of them near copies: most texts stay where they are, and so less is shuffled than they take."""
    from lumengrid.llm import near_copies

    rng = np.random.default_rng(23)
    rows = [(i, " ".join(rng.integers(0, 1 << 60, 1500).astype("U"))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(3)] + [(2000, None), (2001, "")]
    docs = near_copies.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    monkeypatch.setattr(near_copies, "LEAST_TEXTS", 16, raising=False)  # of a sample, which is shuffled
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        time.sleep(1)
        before = written()
        assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [*range(400), 2000]
        time.sleep(1)  # figures of the last tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 0.5 * sum(len(t or "") for _, t in rows)


def test_wanted_rows_are_found_by_their_bits(spark):
    from lumengrid.llm import near_copies

    ids = [*range(200), *range((3 << 33) + 60, (3 << 33) + 70)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "_row long, text string")
    for some in ([], [0], [63, 64, 127, 128], ids[::3], ids):
        got = near_copies.wanted_of(rows, spark.createDataFrame([(i,) for i in some], "_row long")).collect()
        assert sorted(map(tuple, got)) == [(i, f"t{i}") for i in some]


def test_pieces_of_many_texts_are_told(spark):
    from lumengrid.llm import near_copies

    passage = "a passage that many texts have here"  # three pieces
    docs = spark.createDataFrame([(i, f"{passage} {i}") for i in range(50)] + [(100, "the same words again here and")] * 50 + [(200, None)], "doc_id long, text string")
    want = {int.from_bytes(xxhash.xxh128_digest(s, near_copies.SEED)[:8], "big") for s in near_copies.shingles(passage)}
    assert set(near_copies.often_met(docs, 10).tolist()) == want  # copies count once
    assert not len(near_copies.often_met(docs.limit(0), 10))


def test_sets_that_share_enough_have_a_mark_in_common():
    from lumengrid.llm import near_copies

    rng = np.random.default_rng(22)
    for _ in range(20_000):
        both, a, b = rng.integers(0, 40), rng.integers(0, 8), rng.integers(0, 8)
        h = rng.choice(1 << 40, both + a + b, replace=False).astype(np.uint64)
        x, y, often = np.sort(h[: both + a]), np.sort(np.r_[h[:both], h[both + a :]]), h[rng.random(len(h)) < 0.3]
        if len(h) and both / len(h) >= near_copies.LEAST_SHARED:
            common = len(np.intersect1d(near_copies.marks(x, often), near_copies.marks(y, often)))
            assert common >= max(1, near_copies.least_marks(np.array([len(x)]), np.array([len(y)]))[0])


def test_near_dedup_keeps_columns_of_any_name(spark):
    from lumengrid.llm import near_copies

    text = " ".join(f"w{i}" for i in range(60))
    rows = [("a", 7, text, 1.5, "x", None), ("b", 8, text + " more", 2.5, "y", 3), ("c", 9, "another text", None, "z", 4)]
    docs = spark.createDataFrame(rows, "node string, doc_id long, text string, size double, counts string, _row int")
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_counts_rule_out_no_near_copies():
    """Of pairs around the limit, with short, long, blank and repeating texts, what shares enough always passes.

    Of the rest most don't, where texts have some hundred pieces; beyond some thousand, differences in a bin cancel and most do.
    """
    from lumengrid.llm import near_copies

    rng = np.random.default_rng(3)
    texts = ["", " ", "one", "one two", "a " * 3000, "a " * 3001]
    for n in (6, 40, 300, 20_000):
        w = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        for edits in range(0, n // 3 + 1, max(1, n // 60)):
            v = list(w)
            for k in rng.permutation(n)[: edits // 5 + 1] if edits else ():
                v[k] += "x"
            texts.append(" ".join(v))
    made = near_copies.sketch(texts)
    counts = np.frombuffer(b"".join(made["counts"]), np.uint8).reshape(-1, near_copies.BINS)
    sets = [near_copies.shingles(t) for t in texts]
    assert made["size"].tolist() == [len(s) for s in sets]
    passed = others = 0
    for i in range(len(texts)):
        near = np.array([near_copies.shared(sets[i], s) >= near_copies.LEAST_SHARED for s in sets])
        may = near_copies.may_share(made["size"], counts, i, np.arange(len(texts)))
        assert (may | ~near).all()
        some = ~near & (made["size"] <= 300)
        if made["size"][i] <= 300:
            passed, others = passed + (may & some).sum(), others + some.sum()
    assert passed < 0.1 * others


def test_masks_grow_with_the_rows():
    from lumengrid.llm import near_copies

    assert near_copies.masks(1000).shape == (64, 16) == near_copies.masks(1 << 24).shape
    many = near_copies.masks(1 << 30)
    meet = lambda m: 1 - (1 - near_copies.AGREE ** m.shape[1]) ** len(m)
    assert many.shape[1] == 22 and meet(many) >= meet(near_copies.masks(1000)) - 0.01
    assert all(len(set(m)) == 22 for m in many.tolist())


def test_pipeline_stages_on_edge_rows(spark, sf, docs, labels, items, tmp_path):
    """Values that the stages promise for null, empty, repeated and long texts, null ids and empty tables."""
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    own = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line dedup"](spark, own, folder).collect()
    assert len(lines) == len(EDGE) and all(r.text is not None and r.n_chars == len(r.text) for r in lines)
    assert sorted(r.text for r in lines if r.doc_id == 2) == ["short", "short"]
    clean = {r.doc_id for r in stages["benchmark decontamination"](spark, own, folder).collect()}
    assert clean == {3, 4, 5, 7, 8, None}  # 1 and 2 hold an item, 6 another; of the rows without an id one does
    mixed = stages["mixing sources to target weights"](spark, own, folder).collect()
    assert all(r.copies > 0 and r.rate >= 0 for r in mixed) and len(mixed) <= len(EDGE)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), folder).count() == 0, name


def test_operators_on_edge_rows(docs, labels, items):
    """Values that the docstrings promise."""
    by = lambda rows: {(r.doc_id, k): r for k, r in enumerate(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)))}
    hit = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect() if r.doc_id is not None}
    assert [(hit[i].n_words, hit[i].n_hit, hit[i].contaminated) for i in (1, 3, 4, 5)] == [(12, 3, True), (0, 0, False), (0, 0, False), (0, 0, False)]
    assert (hit[6].n_words, hit[6].n_hit, hit[6].item_ids) == (20000, 20000, ["10"])
    rules = by(quality_rules.quality_rules(docs).collect())
    assert all(r.base_failed and not r.kept and r.n_words == 0 for (i, _), r in rules.items() if i in (3, 4, 5))
    prints = by(simhash.near_duplicates(docs).collect())
    assert all(r.fp == 0 for (i, _), r in prints.items() if i in (3, 4, 5)) and {r.component_id for (i, _), r in prints.items() if i in (1, 2)} == {1}
    tox = toxicity.toxicity(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.spans == "" for r in tox if r.doc_id in (3, 4, 5))
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} != set() and all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert all(r.score == 0.5 for r in quality.quality(docs, labels.limit(0)).collect())
    assert len({r.score for r in quality.quality(docs, labels).collect() if r.doc_id in (3, 4)}) == 1
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language.language(docs).collect()}
    assert all(lang[i] == ("und", 0.0) for i in (3, 4, 5)) and all(r.lang_pred == "und" for r in language.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    found, _ = secrets.scan(docs)
    assert {r.doc_id: len(r.spans) for r in found.collect() if r.doc_id is not None} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}
    lm = mixing_lm.lm_scores(docs).collect()
    assert all(r.n_tokens == 1 and r.score < 0 for r in lm if r.doc_id in (3, 4, 5)) and next(r for r in lm if r.doc_id == 6).n_tokens == 20001
    mixed = mixing.mix(docs, mixing.domains(labels.limit(0))).collect()
    assert all(max(r.p) - min(r.p) < 1e-5 for r in mixed) and all(r.n_words == 0 for r in mixed if r.doc_id in (3, 4, 5))
    assert {r.copies for r in mixed if r.doc_id == 2} <= {0, 1, 2} and len({(r.rate, r.copies) for r in mixed if r.doc_id == 2}) == 1


def test_frequent_lines_are_removed(spark, sf):
    """What is removed from the texts are the words that the rules count as removed."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = {r.doc_id: (r.n_words, r.removed_words) for r in quality_rules.quality_rules(docs, least_docs=2).collect()}
    after = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in quality_rules.without_lines(docs, least_docs=2).collect()}
    assert len(after) == len(counted) and sum(x for _, x in counted.values()) > 0
    assert all(after[i] == n - gone for i, (n, gone) in counted.items())


@pytest.mark.parametrize("turn", [1, -1])
def test_decontamination_judges_rows_of_one_id_by_their_own_texts(spark, turn):
    """A short row with an anchor at the same place must not hide the whole item of the other row with its id."""
    item = " ".join(f"i{k}" for k in range(10))
    rows = [(1, item), (1, "a b c d e i1 f"), (1, "i0 b c d e f g"), (None, item), (None, "i0 i1")]
    docs = spark.createDataFrame(rows[::turn], "doc_id long, text string").coalesce(1)
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.text): (r.n_words, r.n_hit, r.item_ids) for r in got} == {
        (1, item): (10, 10, ["5"]), (1, rows[1][1]): (7, 0, []), (1, rows[2][1]): (7, 0, []), (None, item): (10, 10, ["5"]), (None, "i0 i1"): (2, 0, []),
    }


def test_one_huge_text_leaves_the_rest_to_learn_from(spark):
    for huge in range(6):  # whatever its place in the order
        rows = spark.createDataFrame([(i, "x" * (5000 if i == huge else 100), "a") for i in range(6)], "doc_id long, text string, lang string")
        for by in (None, "lang"):
            got = {r.doc_id for r in common.sampled_within(rows, 6, 1000, by).collect()}
            assert got == set(range(6)) - {huge}


def test_language_learns_beside_a_huge_text(spark):
    rows = [(i, "der hund und die katze" if i % 2 else "le chien et le chat", "de" if i % 2 else "fr") for i in range(80)] + [(80, "la " * 5000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rest = common.sampled_within(docs, 1000, 8000, "lang").count()
    assert rest == 80
