"""Corpus operators on documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wirelake.llm import decontam, jaccard, langid, packing, ppm, quality
from wirelake.llm.queries import tokenizer_path
from wirelake.llm.textcodes import ALNUM, LOWER, shingles, word_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, label string"


def make(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [w + rng.choice(["", ",", ".", "é"]) for w in "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()]
    docs = []
    for k in range(n):
        kind = rng.random()
        if docs and kind < 0.3:
            words = docs[rng.randrange(len(docs))][1].split(" ")
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        elif kind < 0.4:
            words = rng.choices(vocab, k=rng.randrange(1, 8))
        else:
            words = rng.choices(vocab, k=rng.randrange(20, 120))
        docs.append((k, " ".join(words).capitalize()))
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (1004, "Ü ß ñ 12 <|endoftext|> ###"), (1005, " ".join(rng.choices(vocab, k=30_000)))]
    return docs


@pytest.fixture(scope="module")
def docs():
    return make()


def frame(spark, docs):
    return spark.createDataFrame([(i, t, ["en", "fr"][(i or 0) % 2], "s", 1, 0.5, 1, "x") for i, t in docs], SCHEMA).repartition(3)


def lower(t):
    return (t or "").encode().translate(LOWER.tobytes())


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(t))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_word_codes_match_regex(docs):
    texts = [None if t is None else t.encode() for _, t in docs]
    for kind, pattern in ((None, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        codes, counts = word_codes(texts) if kind is None else word_codes(texts, kind)
        want = [re.findall(pattern, lower(None if t is None else t.decode())) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        seen = {}
        for w, c in zip((x for own in want for x in own), codes.tolist()):
            assert seen.setdefault(w, c) == c
        assert len(set(seen.values())) == len(seen)


def test_shingles_of_few_words():
    codes, counts = word_codes([b"a b", b"a b c d e f", b"", b"b a"])
    sh, n = shingles(codes, counts, 5)
    assert n.tolist() == [1, 2, 0, 1] and len(set(sh.tolist())) == 4


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)].append(i)
    return [(i, len(s), min(ids[find(k)], default=None)) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def key(rows):
    return sorted(rows, key=str)


def test_jaccard_join(spark, docs):
    got = jaccard.groups(frame(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(tuple(r) for r in got) == key(brute_components(docs))


def hot_docs():
    """Groups of edited copies of texts of 20 to 900 words, most of whose shingles are in passages that many texts share, and unlinked texts with those passages."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    passages = [rng.choices(vocab, k=40) for _ in range(6)]
    docs = []
    for k in range(70):
        body = [w for q in rng.choices(passages, k=rng.choice([1, 1, 3, 12])) for w in q] + rng.choices(vocab, k=rng.choice([0, 4, 15, 60, 400]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(body)
            for _ in range(rng.randrange(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(words)))
    return docs + [(len(docs) + k, " ".join(passages[0][j : j + n])) for k, (j, n) in enumerate([(0, 5), (0, 5), (1, 6), (3, 3), (0, 9), (0, 8)])]


@pytest.mark.parametrize("p", [jaccard.JoinParams(often=4, cell=3), jaccard.JoinParams(often=1 << 20), jaccard.JoinParams(often=8, known=50)])
def test_jaccard_join_with_tokens_of_many_sets(spark, p):
    docs = hot_docs()
    want = brute_components(docs)
    assert sum(n > 64 for _, n, _ in want) > 60 and len({c for *_, c in want}) < len(docs)
    got = jaccard.groups(frame(spark, docs), p).select("doc_id", "n_shingles", "component_id").collect()
    assert key(tuple(r) for r in got) == key(want)


@pytest.mark.parametrize("percent", [80, 90, 60])
def test_signatures_meet_for_every_link(percent):
    rng = random.Random(2)
    p = jaccard.JoinParams(percent=percent, often=64)
    frequency = {}
    met = 0
    for k in range(600):
        n = rng.randrange(2, 90) if k % 3 else rng.randrange(90, 700)
        a = {rng.randrange(1, 4 * n + 2) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randrange(0, max(1, n // 8) + 1)):
            b.discard(rng.choice(sorted(b))) if len(b) > 1 and rng.random() < 0.5 else b.add(rng.randrange(5000, 5400))
        if a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        sig = []
        for s in (a, b):
            tokens = np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            seen = np.array([frequency.setdefault(t, rng.choice([0, 0, 3, 6, 7, 9])) for t in tokens.tolist()], np.int8)
            own, _, place = jaccard.signatures(tokens, seen, p)
            sig.append(dict(zip(own.tolist(), place.tolist())))
        both = sig[0].keys() & sig[1].keys()
        met += 1
        # Of the signatures in common one at least has places that let the link through.
        assert any(min(len(a) - sig[0][s], len(b) - sig[1][s]) * (100 + percent) >= (len(a) + len(b)) * percent for s in both), (a, b)
    assert met > 100


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    p = jaccard.JoinParams()
    left, right, linked = [], [], []
    for n in (1, 5, 63, 64, 65, 120, 129, 1000):
        for change in (0, n // 12, n // 8, n // 3):
            for more in (0, n // 8):
                left.append(rng.integers(1, 1 << 62, n).astype(np.uint64))
                right.append(np.concatenate((left[-1][change:], rng.integers(1, 1 << 62, change + more).astype(np.uint64))))
                linked.append(100 * (n - change) >= 80 * (n + change + more))
    size = lambda x: np.array([len(y) for y in x])
    at = np.arange(len(left))
    may = jaccard.possible(size(left), size(right), [jaccard.parities(x) for x in left], [jaccard.parities(x) for x in right], at, at, p)
    assert may[np.array(linked)].all() and (~may).sum() >= 8


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(frame(spark, docs)).select("doc_id", "text").collect()
    want = brute_components(docs)
    ids = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert ids == sorted({c for i, n, c in want if n and c is not None} | {i for i, n, _ in want if not n})
    assert len(kept) == len(ids)


def test_jaccard_empty(spark, docs):
    assert jaccard.groups(frame(spark, docs).limit(0)).count() == 0


def brute_ppm(docs, train):
    trie, k = defaultdict(Counter), ppm.ORDER
    encoded = [[0xFE] * k + list(lower(t)) + [0xFF] for _, t in docs]
    for e, use in zip(encoded, train):
        if use:
            for i in range(k, len(e)):
                for j in range(k + 1):
                    trie[tuple(e[i - j : i])][e[i]] += 1
    out = []
    for e in encoded:
        total = 0.0
        for i in range(k, len(e)):
            gone = set()
            for j in range(k, -1, -1):
                left = {s: c for s, c in trie.get(tuple(e[i - j : i]), {}).items() if s not in gone}
                if not left:
                    continue
                n = sum(left.values())
                if e[i] in left:
                    total += math.log10((left[e[i]] - 0.5) / n)
                    break
                total += math.log10(len(left) / (2 * n))
                gone |= set(left)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("common", [250_000, 300, 0])
def test_lm_scores(spark, docs, common):
    docs = [d if d[0] != 1005 else (1005, d[1][:9000]) for d in docs] + [docs[4]] * 150
    rows = ppm.scores(frame(spark, docs), ppm.PpmParams(blocks=6, common=common)).collect()
    assert len(rows) == len(docs)
    train = [i is not None and crc(i, 7) != 2 for i, _ in docs]
    tokens = [[*words(t), None] for _, t in docs]
    counts = Counter(w for own, use in zip(tokens, train) if use for w in own)
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for (i, _), own, s in zip(docs, tokens, brute_ppm(docs, train)):
        want[i] = (len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), s)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-9)
        assert r["held_out"] == (None if r["doc_id"] is None else crc(r["doc_id"], 7) == 2)


def test_lm_scores_without_training(spark):
    r = ppm.scores(spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(x["n_tokens"] for x in r) == [1, 2] and all(x["score"] < 0 for x in r)
    assert ppm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ITEMS = [(1, "the of and to in that is was he for it with"), (2, "not are but"), (10, "Not are BUT"), (3, None), (None, "an they"), (4, "  ## "), (5, "they which one you the of and to in that")]


def brute_hits(docs, items, width=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for i, t in docs:
        w = split(t)
        hit, who = set(), set()
        for item, text in items:
            x = split(text)
            if item is None or not x:
                continue
            n = min(width, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    who.add(str(item))
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_decontamination(spark, docs, block_words):
    docs = [*docs, (2000, "x " + ITEMS[0][1].upper() + " y; Not-are.but"), (2001, "they which one you the of and to in that is was he for it with")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    p = decontam.DecontamParams(block_words=block_words)
    got = decontam.contamination(frame(spark, docs), bench, p).collect()
    assert key(tuple(r) for r in got) == key(brute_hits(docs, ITEMS))
    left = decontam.clean(frame(spark, docs), bench, p).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(r[0]) for r in brute_hits(docs, ITEMS) if not r[5])


def test_decontamination_without_items(spark, docs):
    got = decontam.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] for r in got)


def test_longest_matches():
    b = decontam.prepare([7], [b"a b c d e f g h"], 3)
    codes, counts = word_codes([b"x a b c d e y f g h", b"c d e f"], ALNUM)
    (found,) = decontam.occurrences(codes, counts, b)
    pos, _, offset, length = decontam.longest_matches(*found)
    assert sorted(zip(pos.tolist(), offset.tolist(), length.tolist())) == [(1, 0, 5), (7, 5, 3), (10, 2, 4)]


def test_many_occurrences_of_many_items_are_held_in_parts():
    b = decontam.prepare(list(range(400)), [b"word"] * 400, 10)
    codes, counts = word_codes([b"word other " * 10_000, b"word " * 2, b"other"], ALNUM)
    assert max(len(part[0]) for part in decontam.occurrences(codes, counts, b)) <= decontam.PAIRS
    first, end, doc, item = decontam.shard_hits(codes, counts, b)
    assert (end - first).sum() == 10_002 and len(item) == 800 and set(doc.tolist()) == {0, 1}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    p = packing.PackParams(tokenizer_path(), group_docs=20)
    rows = packing.pack(frame(spark, docs), p).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(list)
    for i, text in docs:
        ids[i].append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    sequences = defaultdict(list)
    parts = defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] in {len(x) for x in ids[r["doc_id"]]}
        own = next(x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append(r["length"])
    assert {i: sum(v) for i, v in parts.items()} == {i: sum(map(len, v)) for i, v in ids.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


def test_first_fit_decreasing_against_plain():
    rng = random.Random(4)
    for _ in range(50):
        sizes = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))])
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for k in np.argsort(-sizes, kind="stable"):
            b = next((i for i, r in enumerate(room) if r >= sizes[k]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= sizes[k]


def test_tokenizer_parts():
    w = packing.WordTokenizer(tokenizer_path())
    texts = ["it's a b’s I'LL\u3000x <|endoftext|>y \x1c\x1dq\u0301 Σ ΑΣ Σας ß ©& 12 3.4\x85n", "İstanbul \u1112\u1161\u11ab don't don’t ½ x² 'dx 'RE", "", None, "a" * 3000, "Ünïcode,;: naïve—word…"]
    assert list(w.ids(texts)) == [np.array(w.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ño", "ción", "ados", "illa"]}
    rows = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, "kato miru", "aa"), (903, "schungein " * 200_000, None), (0, rows[0][1], "aa")]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", __import__("pyspark").sql.functions.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(240) if crc(i, 4) == 2]
    assert held and all(by[i]["held_out"] for i in held)
    assert sum(by[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_quality(spark, docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = " ".join(rng.choices("alpha beta gamma delta".split(), k=40)) if good else " ".join(["BUY!!"] * 10 + rng.choices("alpha beta | |".split(), k=20))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, "alpha " * 300_000), (None, "alpha beta"), (5, rows[5][1])]
    labels += [(5, labels[5][1], 0), (None, 1, 0), (7, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality.classify(d, lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
