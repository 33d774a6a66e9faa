"""Suffix-array dedup, ranked search and tokenizer alignment against brute-force versions, on edge rows and crowded keys."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import alignment, language, quality, ranked_search, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string"


def some_words(rng, n=300):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n)] + ["ñandú", "漢字", "É"]


def removed_by_brute_force(docs, size, first):
    """What is left of each text without the bytes of strings that start at another place, or at an earlier one."""
    at, texts = defaultdict(list), [(t or "").encode() for _, t in docs]
    for d, b in enumerate(texts):
        for i in range(len(b) - size + 1):
            at[b[i : i + size]].append((docs[d][0], d, i))
    out = []
    for d, b in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            places = at[b[i : i + size]]
            if min(places) != (docs[d][0], d, i) if first else len(places) > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((docs[d][0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating_texts():
    rng = np.random.default_rng(3)
    words = some_words(rng)
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    notice, base, docs = text(90), text(150), []
    for i in range(100):
        t, line = text(int(rng.integers(5, 120))), text(13)
        edited = base.split(" ")
        edited[int(rng.integers(0, 150))] = f"EDIT{i}"
        kinds = [t, f"{t} {notice} {text(20)}", " ".join(edited), base, text(3) + "ab" * int(rng.integers(50, 300)) + text(5), line + line + text(9) + line * 3, notice[int(rng.integers(0, 200)) : int(rng.integers(300, 600))], (line + "\n") * 2]
        docs.append((i, kinds[i % 8]))
    return docs + [(500, None), (501, ""), (502, base[:199]), (503, base[:200]), (504, "x" * 5000)]


@pytest.mark.parametrize(("size", "first", "most"), [(200, False, 4096), (200, True, 4096), (200, False, 3), (60, True, 3)])
def test_suffix_dedup_matches_brute_force(spark, size, first, most):
    """With few kinds of contexts to a suffix array, crowded anchors are split, with the same result."""
    docs = repeating_texts()
    if not first:
        docs += [docs[7], (docs[9][0], docs[10][1]), docs[-1]]  # equal rows, and an id with another text
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, SCHEMA).repartition(5), size, first, most=most)
    rows = got.collect()
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == removed_by_brute_force(docs, size, first)
    for r in rows:
        b, end = (r.text or "").encode(), 0
        kept = b""
        for s in r.spans:
            kept, end = kept + b[end : s.start], s.end
        assert kept + b[end:] == bytes(r.kept) and len(r.spans) == r.n_spans


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    held = rng.integers(97, 99, 400).astype(np.uint8)
    for size in (3, 8, 30, 200):
        ranks = suffix_dedup.suffix_ranks(held, size)
        cut = [bytes(np.concatenate([held, np.full(size, 255, np.uint8)])[i : i + size]) for i in range(400)]
        assert [sorted(set(cut)).index(x) for x in cut] == ranked_again(ranks)


def ranked_again(ranks):
    """Ranks without gaps."""
    return np.unique(ranks, return_inverse=True)[1].tolist()


def test_suffix_dedup_on_edge_tables(spark):
    empty = suffix_dedup.suffix_dedup(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    rows = [(None, None, 1, "a", 3), (None, "x" * 300, 2, "b", 4), (3, "y" * 250, 3, None, None)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, h string, spans int"))
    assert got.columns == ["doc_id", "text", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    assert sorted((r.n_bytes, r.n_removed) for r in got.collect()) == [(0, 0), (250, 250), (300, 300)]


def found_by_brute_force(docs, items, k):
    """Every item's k best documents, from all scores."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words = [Counter(cut(t)) for _, t in docs]
    n, total, df = sum(1 for w in words if w), sum(sum(w.values()) for w in words), Counter(t for w in words for t in w)
    out = []
    for item, text in items:
        scores = []
        for (i, _), w in zip(docs, words, strict=True):
            m = 50 + (50 * sum(w.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * w[t]) // (1000 * w[t] + 20 * m)) for t in set(cut(text)) if w[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block", "stride", "limit", "most"), [(1 << 24, 128, 2048, 200_000, 1 << 16), (3000, 4, 16, 200_000, 20), (20_000, 3, 5, 0, 50)])
def test_ranked_search_matches_brute_force(spark, shard, block, stride, limit, most):
    """Also with small shards and blocks, several batches of items, and nothing broadcast."""
    rng = np.random.default_rng(5)
    words = some_words(rng, 60)
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(words[i] for i in rng.choice(len(words), n, p=weights / weights.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(20)] + [docs[5], (3, docs[9][1]), (None, docs[5][1]), (None, None), (900, ""), (901, "..!"), (902, text(4000)), (903, "Ñandú É ñandú é")]
    items = [(i, text(8)) for i in range(12)] + [(3, docs[5][1].upper()), (3, docs[5][1].upper()), (20, None), (21, ""), (22, "zzzzzzzzzz"), (None, text(3)), (23, "é É")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if limit == 0 else 10485760)
    try:
        index = ranked_search.build_index(spark.createDataFrame(docs, SCHEMA).repartition(3), shard, block)
        got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, limit, most, stride).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == found_by_brute_force(docs, items, 10)


def test_ranked_search_leaves_blocks_packed():
    """A rare term makes the common one's list not essential, and its blocks without a candidate stay packed."""
    n = 40_000
    lengths, everywhere, rare = np.full(n, 20), np.arange(n), np.arange(0, 600, 10)
    lists = ranked_search.Lists(lengths, n, 20 * n)
    for term, docs in enumerate((everywhere, rare)):
        rows, ends = [], []
        for a in range(0, len(docs), 128):
            d = docs[a : a + 128]
            b, _ = ranked_search.packed(np.stack([np.diff(d, prepend=0), np.ones(len(d), np.int64)], 1).ravel())
            rows.append(b.tobytes())
            ends.append([d[-1], 1, 20, sum(map(len, rows))])
        lists.add(term, b"".join(rows), np.array(ends, "<i4").tobytes())
    docs, scores = ranked_search.best_of(lists, [(0, 1), (1, 9000)], np.arange(n), 50)
    assert docs.tolist() == rare[:50].tolist() and len(set(scores.tolist())) == 1
    assert lists.unpacked < 30 < len(lists.of[0][1])


def test_packing_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2_000_000, 300_000_000])
    assert ranked_search.unpacked(ranked_search.packed(v)[0]).tolist() == v.tolist()


def test_ranked_search_on_edge_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(docs.limit(0)), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).count() == 0
    extra = docs.selectExpr("doc_id", "text", "1 AS shard", "'x' AS term", "2 AS score")
    assert [tuple(r) for r in ranked_search.search(ranked_search.build_index(extra), items.selectExpr("*", "1 AS rank", "2 AS item")).collect()] == [(1, 1, 1, 287 * (1000000000 // (1000 + 2000)))]


def aligned_by_brute_force(docs):
    """Groups from the offsets where tokens of both kinds end, all links one by one, and their counts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")
    letters, rows, counts = alignment.byte_of_letter(), [], Counter()
    for i, text in docs:
        groups, whole = [], (" " + (text or "")).encode()
        e = a_of.encode(" " + (text or ""), add_special_tokens=False)
        a = [bytes(letters[c] for c in t) for t in e.tokens]
        ids = b_of.encode(text or "")
        b = [bytes([int(b_of.id_to_piece(x)[3:5], 16)]) if b_of.is_byte(x) else b_of.id_to_piece(x).replace("\u2581", " ").encode() for x in ids]
        if text and b"".join(a) == whole == b"".join(b):
            a_end, b_end = (np.cumsum([len(x) for x in t]).tolist() for t in (a, b))
            cuts = sorted(set(a_end) & set(b_end))
            groups = [([], []) for _ in cuts]
            for side, (own, ends) in enumerate(((e.ids, a_end), (ids, b_end))):
                for x, end in zip(own, ends, strict=True):
                    groups[bisect.bisect_left(cuts, end)][side].append(x)
        rows.append((i, groups))
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups in rows:
        links = [(x, y) for p, q in groups for x in p for y in q]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sums = sum(counts[k] == top[k[0]] for k in links), sum(counts[k] for k in links)
        out.append((i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), *sums, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = ["a", None, "", " ", "漢字かな交じり文です。" * 20, "<|endoftext|> <s> </s> \u2581x", "<|endoftext|> <s>", "\x00\x01", "a" * 5000, "ab漢" * 3000, " \n\n  x  \t", "1234567890" * 400, "é̀ﬁ№𝔘😀👨‍👩‍👧"]


@pytest.mark.parametrize(("head", "laid_out", "kept"), [(1 << 20, 1 << 21, 1 << 22), (0, 1 << 21, 10), (50, 200, 1000)])
def test_alignment_matches_brute_force(spark, sf, monkeypatch, head, laid_out, kept):
    """Also without a table of frequent pairs, and with texts laid out group by group and counts passed on early."""
    monkeypatch.setattr(alignment, "LAID_OUT", laid_out)
    monkeypatch.setattr(alignment, "SUMMED", kept)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), docs[0], (docs[1][0], docs[2][1])]
    got = alignment.align(spark.createDataFrame(docs, SCHEMA).repartition(3), head=head).collect()
    assert sorted((tuple(r) for r in got), key=str) == aligned_by_brute_force(docs)


def test_both_byte_level_encoders_agree():
    """Merging by rank gives what the tokenizer's file gives, whatever the letters."""
    e = alignment.encoders(alignment.FOLDER)
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}!{chr(c)}" for c in range(1, 0x3000, 3)] + [t for t in ODD if t]
    assert [e.slow.encode(" " + t, add_special_tokens=False).ids for t in texts] == e.encode(texts)[0]


def test_alignment_on_edge_tables(spark):
    empty = alignment.align(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    extra = spark.createDataFrame([(1, "a b", 2, "x", 3)], "doc_id long, text string, row int, pair string, n_a int")
    assert [r.n_a for r in alignment.align(extra).collect()] == [2]


# results of the trained operators, by plain arithmetic from their fitted models


def plain_segments(s):
    """All maximal segments: the best one of a stretch, then those left and right of it."""
    out, todo = [], [(0, len(s))]
    while todo:
        a, z = todo.pop()
        best = None
        for i in range(a, z):
            total = 0.0
            for j in range(i, z):
                total += s[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            out.append((best[1], best[2], best[0]))
            todo += [(a, best[1]), (best[2], z)]
    return sorted(out)


def test_toxicity_scores_match_plain_segments(spark, sf):
    """Every document's score from the entries, by a search of all segments, and its spans."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    some = docs.where(F.length("text") < 1500)
    found = 0
    for r in toxicity.score(some.select("doc_id", "text"), model).collect():
        s = []
        for w in toxicity.words(r.text):
            own = [model["entries"][x] for x in [w[:n] for n in model["prefixes"] if len(w) >= n] + [w + "$"] if x in model["entries"]]
            s.append((own[-1] if own else 0.0) - toxicity.DRIFT)
        logs, spans = 0.0, []
        for a, z, total in plain_segments(s):
            p = -math.expm1(-model["k"] * len(s) * math.exp(-model["lam"] * total))
            if p < toxicity.SIGNIFICANT:
                logs -= math.log(max(p, 1e-300))
                spans.append((a, z))
        want = 1 / (1 + math.exp(-(model["slope"] * math.log1p(logs) + model["intercept"])))
        assert math.isclose(r.toxic_score, want, rel_tol=1e-6, abs_tol=1e-9)
        assert [tuple(map(int, x.split(":")[:2])) for x in r.toxic_spans.split(",") if x] == spans
        found += bool(spans)
    assert found


def test_quality_scores_match_plain_sums(spark, sf):
    """Every document's score from the weights: features counted one by one, and a sum over them."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = quality.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.quality(docs, labels).collect()}
    mask, quarter = (1 << 64) - 1, quality.DIM // 4

    def place(h, k):
        h = (h + (1 << 63)) & mask
        h -= 1 << 63
        return ((h ^ (h >> 21)) & (quarter - 1)) + k * quarter

    for r in docs.collect():
        tokens = re.findall(r"\w+|[^\w\s]+", r.text or "")
        words = [zlib.crc32(t.lower().encode()) for t in tokens]
        shapes = []
        for i, t in enumerate(tokens):
            kind = 4 if not (t[0].isalnum() or t[0] == "_") else 3 if t.isdigit() else 2 if t.isupper() and len(t) > 1 else 1 if t[0].isupper() else 0
            shapes.append(kind + 8 * (i > 0 and words[i] == words[i - 1]))
        bags = [Counter() for _ in range(4)]
        for i in range(len(tokens)):
            bags[0][place(words[i] * 2654435761 + 1, 0)] += 1
            if i:
                bags[1][place(words[i] * 40503 + words[i - 1] * 2654435761 + 2, 1)] += 1
                bags[2][place((shapes[i] * 16 + shapes[i - 1]) * 7919 + 3, 2)] += 1
            if i > 1:
                bags[3][place((shapes[i] * 256 + shapes[i - 1] * 16 + shapes[i - 2]) * 104729 + 4, 3)] += 1
        dot = float(w[0]) + sum(float(w[i]) * n / math.sqrt(sum(x * x for x in bag.values())) for bag in bags for i, n in bag.items())
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, dot))))
        assert math.isclose(got[r.doc_id][0], want, rel_tol=1e-5, abs_tol=1e-7) and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.7)


def test_language_scores_match_a_plain_softmax(spark, sf):
    """Every document's language and probability from the weights, n-gram by n-gram."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language(docs).collect()}
    for r in docs.where(F.length("text") < 3000).collect():
        c, tf = [ord(x) for x in r.text.lower()], Counter()
        for i in range(len(c)):
            tf[(c[i] * 2654435761) % 2**32 >> 17] += 1
            if i:
                tf[(c[i - 1] * 2246822519 + c[i] * 3266489917 + 1) % 2**32 >> 17] += 1
            if i > 1:
                tf[(c[i - 2] * 668265263 + c[i - 1] * 374761393 + c[i] * 2869860233 + 2) % 2**32 >> 17] += 1
        if not any(x.isalpha() for x in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = {i: (1 + math.log(n)) * m["idf"][i] for i, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * m["weights"][i][k] for i, v in x.items()) / m["temperature"] for k in range(len(m["langs"]))]
        e = [math.exp(v - max(logits)) for v in logits]
        best = max(range(len(e)), key=lambda k: e[k])
        assert got[r.doc_id][0] == m["langs"][best] and math.isclose(got[r.doc_id][1], e[best] / sum(e), rel_tol=1e-4)
