"""Each operator against brute force, on small documents with nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import ann, decontam, langid, lines, lm, ngram_join, packing, phrases, quality, sharding  # noqa: E402
from tidemark.llm import queries as q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, chunk string, `a.b` int"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = say(60), say(80)
    texts = [None, "", " \n ", "one", "One two three four", base, base, base.replace("w1 ", "x ", 1), "ÀÉ é-x", shared, "a " * 200]
    texts += [say(rng.randint(1, 120)) for _ in range(20)] + [say(20) + " " + shared + "\n" + say(30) for _ in range(3)]
    for _ in range(4):
        words = base.split()
        words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    texts += ["\n".join([*(f"line number {k}" for k in range(14)), say(5)]) for _ in range(4)]
    return [(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_ngram_join(docs, none):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in pairs(docs):
        w = (t or "").translate(low).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(root.values())
    assert ngram_join.classes(none).count() == 0
    _, labels = ngram_join.text_classes(docs, rounds=0)  # rounds save pairs, they decide nothing
    _, after = ngram_join.text_classes(docs)
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in after.collect()}


def test_signature_tree_traversal_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, 60).astype(np.uint64)) for _ in range(12)]
    sets += [np.unique(np.concatenate([s[: len(s) - 4], rng.integers(5000, 9000, 4).astype(np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    bits = np.stack([np.frombuffer(ngram_join._signature(s), "<u8") for s in sets])
    t = ngram_join.Tree(n, n, n, np.arange(len(sets)), bits)
    i, j = ngram_join.traverse(t, t, True, 75)
    met = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert (a, b) in met


def test_phrases(docs, none):
    c, split = collections.Counter(), [(i, (t or "").encode().split()) for i, t in pairs(docs)]
    for _, w in split:
        c.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    got = {r["doc_id"]: tuple(r)[1:] for r in phrases.summary(docs).collect()}
    for i, w in split:
        gone = [any(c[tuple(w[s : s + 35])] > 1 for s in range(max(0, k - 34), min(k, len(w) - 35) + 1)) for k in range(len(w))]
        assert got[i] == (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    assert phrases.summary(none).count() == 0
    many = phrases.remove_repeats(docs, shard_bytes=300, stream_bytes=200)
    assert {r["doc_id"]: tuple(r)[1:] for r in many.collect()} == got


def test_phrases_in_pieces():
    rng = random.Random(8)
    say = lambda n: [rng.choice("abc") for _ in range(n)]
    held = [say(5), say(9), say(40), ["a"] * 30]
    texts = [say(200), [*say(3), *held[2], *say(4), *held[0]], ["a"] * 90, held[1], ["z"] * 5]
    got = phrases.locate([" ".join(p) for p in held], [" ".join(t) for t in texts], piece=8)
    parts = [p[i:j] for p in held for i, j in phrases._pieces(len(p), 8)]
    for text, mark in zip(texts, got, strict=True):
        want = [False] * len(text)
        for p in parts:
            for k in range(len(text) - len(p) + 1):
                if text[k : k + len(p)] == p:
                    want[k : k + len(p)] = [True] * len(p)
        assert mark.tolist() == want
    assert all(got[3]) and not any(got[4]) and all(got[1][3:43])


def test_lines(docs, none):
    first, want = set(), {}
    for i, t in sorted(pairs(docs)):
        if t is None:
            want[i] = None
            continue
        rows, found = lines.chunks(t.encode())
        keep = []
        for a, b in found:
            body = b"\n".join(rows[a:b])
            if b - a < 2 or body not in first:
                keep += rows[a:b]
            if b - a >= 2:
                first.add(body)
        want[i] = b"\n".join(keep).decode()
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns and dict(pairs(out)) == want
    assert any(w != t for (i, t), w in zip(sorted(pairs(docs)), (want[k] for k in sorted(want)), strict=True))
    assert lines.report(none).count() == 0


def test_line_blocks_found_by_brute_force():
    rng = random.Random(5)
    fresh = lambda n: [f"line {rng.random()}" for _ in range(n)]
    blocks = [fresh(rng.randint(3, 6)) for _ in range(300)]
    texts = [fresh(rng.randint(1, 9)) + b + fresh(rng.randint(1, 9)) for _ in range(2) for b in blocks]
    texts += [fresh(3) + ["same"] * 40 + fresh(3), fresh(2) + ["a", "b"] * 20 + fresh(3), fresh(3) + ["a", "b", "c"] * 15 + fresh(3)]
    seen, stay = set(), []
    for t in texts:
        rows, found = lines.chunks("\n".join(t).encode())
        assert [x for a, b in found for x in rows[a:b]] == rows and found[-1][1] == len(t)
        bodies = [(tuple(t[a:b]), b - a >= 2) for a, b in found]
        keep = []
        for body, whole in bodies:
            keep += [] if whole and body in seen else body
            if whole:
                seen.add(body)
        stay.append(keep)
    windows, touched, gone, there = set(), 0, 0, 0
    for n, (t, keep) in enumerate(zip(texts[:600], stay, strict=False)):
        triples = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
        again = {x for w in triples if w in windows for x in w}
        windows.update(triples)
        assert set(t) - set(keep) <= again
        if n >= 300:
            assert set(blocks[n - 300]) == again
            touched, gone, there = touched + (len(keep) < len(t)), gone + len(t) - len(keep), there + len(again)
    assert touched >= 0.75 * 300 and gone >= 0.5 * there
    assert stay[600].count("same") <= 4 and len(stay[601]) <= 5 + 4 and len(stay[602]) <= 6 + 15 + 4


def test_decontamination(spark, docs, none):
    shared = corpus()[9][1].split()
    bench = spark.createDataFrame([(1, " ".join(shared[5:30]).upper()), (2, "one"), (3, None), (4, "never seen at all"), (5, "one")], "item_id long, text string")
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = word.findall((r["text"] or "").translate(low))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    for limit in (decontam.BROADCAST_BYTES, 0):  # the broadcast and the shuffled join
        decontam.BROADCAST_BYTES, old = limit, decontam.BROADCAST_BYTES
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
        decontam.BROADCAST_BYTES = old
        for i, t in pairs(docs):
            w, hit, items = word.findall((t or "").translate(low)), set(), set()
            for key, ids in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        items |= ids
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert decontam.decontaminate(none, bench).count() == 0


def test_packing_is_an_exact_round_trip(docs, none):
    path = q.tokenizer_path()
    rows = packing.pack(docs, path).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for i, t in pairs(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        mine = rows[rows.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) // 4 == mine.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert packing.pack(none, path).count() == 0


def test_column_generation_meets_demand():
    demand = {3: 40, 5: 17, 7: 30, 9: 4, 16: 2}
    made = collections.Counter()
    used = 0
    for pattern, n in packing.plan(demand, 16):
        used += n
        assert sum(s * a for s, a in zip(sorted(demand), pattern.tolist(), strict=True)) <= 16
        for s, a in zip(sorted(demand), pattern.tolist(), strict=True):
            made[s] += a * n
    assert made == demand and used <= -(-sum(s * n for s, n in demand.items()) // 16) + 2


def test_sharding(docs, none):
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == docs.count() and (got.groupby("shard").slot.max() + 1 == got.groupby("shard").size()).all()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) <= {16}
    assert sharding.shard_documents(none).count() == 0


def test_map_versions(spark, tmp_path, docs):
    first = sharding.initial_map(spark, 4, 64)
    more = sharding.grow(first, 4)
    assert {r["shard"]: r["count"] for r in more.groupBy("shard").count().collect()} == {0: 13, 1: 13, 2: 13, 3: 13, 4: 12}
    for m in (first, more):
        sharding.save_map(m, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).first()["version"] == 2


def test_language(spark, docs, none):
    en, fr = "the quick brown fox jumps over it ", "le renard brun saute par dessus la haie "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 5), "en" if i % 2 else "fr") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "fr"), (None, en, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (900, 901)} == {900: "und", 901: "und"}
    assert langid.keep_known(docs).columns == docs.columns and langid.identify(none).count() == 0


def test_long_texts_keep_their_margin(spark):
    rng = random.Random(9)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(2000)] for k, letters in (("en", "etaoinshr"), ("fr", "esaitnruéè"))}
    say = lambda k, n: " ".join(rng.choices(vocab[k], k=n))
    learned = langid.fit(spark.createDataFrame([(say(k, 300), k) for k in vocab for _ in range(60)], "text string, lang string"))
    clean = {n: say("en", n // 7) for n in (20_000, 200_000, 1_000_000)}
    clean[10_000_000] = clean[1_000_000] + "".join(" " + say("en", 1_000_000 // 7) for _ in range(9))
    mixed = "".join(say("en", 5000) + " " + say("fr", 5000) + " " for _ in range(100))
    rows = [(n, t) for n, t in clean.items()] + [(1, mixed)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), learned).drop("text").collect()}
    assert all(got[n]["__lang_pred"] == "en" and not got[n]["__rejected"] for n in clean)
    assert got[10_000_000]["__score"] > 0.8 * got[200_000]["__score"]
    assert got[1]["__score"] < 0.1 * got[10_000_000]["__score"]


def test_copies_do_not_use_up_the_sample(spark):
    texts = [f"{c * 5} word" for c in "abcdefghijklmnopqrst"]
    learned = langid.fit(spark.createDataFrame([(t, "en") for t in texts for _ in range(200)], "text string, lang string"))
    assert sorted(re.findall(r"\w+ word", learned["en"].decode())) == texts


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16))
    v[10:40] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search_hundredths(e).toPandas()
    assert got["query_id"].nunique() == 6 and (got.groupby("query_id").size() == 10).all()
    hit = 0
    for i in range(0, 600, 100):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert np.allclose(mine.score, d[mine.vec_id]) and mine.score.is_monotonic_increasing
        hit += len(set(mine.vec_id) & set(np.lexsort((np.arange(600), d))[:10]))
    assert hit >= 54


def test_scores_and_resampling(spark, docs, none):
    scores = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert scores[0]["n_words"] == 0 and scores[0]["log_score"] == 0 and scores[0]["mean_log_score"] is None
    split = {i: (t or "").encode().split() for i, t in pairs(docs)}
    c = [collections.Counter(tuple(w[k : k + n]) for w in split.values() for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = c[0].total()

    def one(w, k):
        uni, bi, tri = (w[k],), tuple(w[k - 1 : k + 1]), tuple(w[k - 2 : k + 1])
        s = np.log(c[0][uni] / total)
        if k:
            s = np.log((c[1][bi] - 1) / (c[0][bi[:1]] - 1)) if c[1][bi] > 1 else np.log(0.4) + s
        if k > 1:
            s = np.log((c[2][tri] - 1) / (c[1][tri[:2]] - 1)) if c[2][tri] > 1 else np.log(0.4) + s
        return s

    assert {i: r["log_score"] for i, r in scores.items()} == pytest.approx({i: sum(one(w, k) for k in range(len(w))) for i, w in split.items()})
    assert lm.score(none).count() == 0
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels, 0.5).count() == round(docs.count() * 0.5)
    assert quality.resample(none, labels).count() == 0
    keyed = spark.range(1000).selectExpr("id AS doc_id", "id AS h", "cast(id % 10 as double) AS key")
    top = [r["key"] for r in quality.top_k(keyed, 150).collect()]
    assert len(top) == 150 and sorted(top) == [8.0] * 50 + [9.0] * 100


def cut_lines(rows):
    """Chunks of two lines, straight from their definition: no rolling, no byte arrays."""
    import xxhash

    turn = lambda x: (x << 7 | x >> 57) & (2**64 - 1)
    hashes = [xxhash.xxh3_64_intdigest(x) for x in rows]
    places = sorted(((turn(a) ^ b) * 0x9E3779B97F4A7C15 % 2**64, i) for i, (a, b) in enumerate(zip(hashes, hashes[1:], strict=False)))
    begins, used = set(), set()
    for _, i in places:
        if not {i, i + 1} & used:
            begins.add(i)
            used |= {i, i + 1}
    out, at = [], 0
    while at < len(rows):
        out.append((at, at + 2 if at in begins else at + 1))
        at = out[-1][1]
    return out


def lines_by_hand(rows):
    """rows: (sort key, text) of different documents in order; the texts that stay."""
    seen, out = set(), []
    for key, text in rows:
        lines_of = text.encode().split(b"\n")
        keep = []
        for a, b in cut_lines(lines_of):
            body = b"\n".join(lines_of[a:b])
            keep += lines_of[a:b] if b - a < 2 or body not in seen else []
            seen |= {body} if b - a == 2 else set()
        out.append((key, b"\n".join(keep).decode()))
    return out


def test_line_chunks_without_their_own_chunker(docs):
    rows = sorted((i, t) for i, t in pairs(docs) if t is not None)
    assert dict(lines_by_hand(rows)) == {i: t for i, t in pairs(lines.without_repeats(docs)) if t is not None}


def test_lines_of_any_id(spark):
    text = "\n".join(f"line {k}" for k in range(8))
    for kind, ids in (("long", [None, -1, 5, 5]), ("string", [None, "", "x", "x"])):
        rows = [(i, text) for i in ids]
        got = [(r["doc_id"], r["text"]) for r in lines.without_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()]
        assert [t for i, t in got if i is None] == [text]  # the first of all stays whole
        gone = lines_by_hand([(0, text), (1, text)])[1][1]
        assert {t for i, t in got if i is not None} == {gone} and len(got) == 4


def test_one_of_each_class_with_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, a), (None, a), (3, a), (3, a), (4, b), (4, a + " more"), (None, b), (7, None), (7, None), (8, " "), (9, "few words"), (9, "few words")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, pairs(got))) == sorted(map(str, [(3, a), (4, b), (7, None), (7, None), (8, " "), (9, "few words")]))


def test_log_weights_by_hand(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    from tidemark.llm._text import Words, gram_hashes

    def grams(text):
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        one = [int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), seed=1).hash[0]) for w in words]
        two = [int(gram_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(one, one[1:], strict=False)]
        return [h >> (64 - quality.BITS) for h in one + two]

    of = {i: grams(t) for i, t in pairs(docs)}
    good = {i for i in range(40) if i % 3 and i % 7}
    raw, target = collections.Counter(g for x in of.values() for g in x), collections.Counter(g for i, x in of.items() if i in good for g in x)
    share = target.total() / raw.total()
    ratio = lambda g: np.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR))
    table = quality.log_ratio(quality.counts(quality.target_rows(docs, labels)), quality.counts(docs.select("text")))
    got = {r["doc_id"]: r["log_weight"] for r in quality.weights(docs.select("doc_id", "text"), table).collect()}
    assert got == pytest.approx({i: sum(map(ratio, x)) for i, x in of.items()}, abs=1e-4)
    keys = {r["doc_id"]: r["key"] for r in quality.weights(docs.select("doc_id", "text"), table).collect()}
    picked = {r["doc_id"] for r in quality.resample(docs, labels, 0.4).collect()}
    assert picked == set(sorted(keys, key=lambda i: -keys[i])[: round(0.4 * len(keys))])


def test_top_k_of_repeated_rows(spark):
    rows = spark.sql("SELECT 1L AS doc_id, 5L AS h, 2.0D AS key FROM range(5000) UNION ALL SELECT 2L, 6L, 2.0D FROM range(10)")
    got = collections.Counter(r["doc_id"] for r in quality.top_k(rows, 5004).collect())
    assert got == {1: 5000, 2: 4}


def test_language_by_hand(spark):
    import zstandard as z

    rng = random.Random(4)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(300)] for k, a in (("aa", "etaoins"), ("bb", "ruéèlmp"), ("cc", "xyzwkjq"))}
    say = lambda k, n: " ".join(rng.choices(vocab[k], k=n))
    rows = [(i, say(k, rng.randint(1, 400)), k) for i, k in enumerate(rng.choices(sorted(vocab), k=150))] + [(500, say("aa", 60) + say("bb", 60), None)]
    learned = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == set(vocab)
    want = {}
    for i, text, _ in rows:
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = {}
        for k, d in learned.items():
            c = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(data[a : a + langid.BLOCK_BYTES])) for a in range(0, len(data), langid.BLOCK_BYTES))
        best, second = sorted((v, k) for k, v in sizes.items())[:2]
        want[i] = (best[1], (second[0] - best[0]) / second[0])
    got = {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert {i: g[1] for i, g in got.items()} == pytest.approx({i: w[1] for i, w in want.items()}, abs=0.02)
    assert sum(got[i][0] == k for i, _, k in rows[:150]) >= 145


def test_every_language_is_learned(spark):
    rows = [(f"word{k} of language {k} " * 9, f"l{k}") for k in range(300)]
    learned = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(learned) == 300
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "text string, lang string"), total_bytes=200 * langid.LEAST_BYTES)


def test_slots_by_hand(spark, docs):
    rows = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text").limit(5)).unionAll(spark.sql("SELECT CAST(NULL AS LONG), 'x' FROM range(3)"))
    got = sharding.shard_documents(rows).toPandas()
    assert len(got) == rows.count()
    of = {r["doc_id"]: r["s"] for r in rows.select("doc_id", sharding.virtual_slot("doc_id").alias("s")).collect()}
    for r in got.itertuples():
        i = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert r.virtual_slot == of[i] and r.shard == of[i] % 16 and r.grown_shard in (r.shard, 16)
    sizes = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(rows))
    assert sizes == collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.size, r.text_crc32) for r in got.itertuples())
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and own.sort_values("slot").virtual_slot.is_monotonic_increasing
    load = got.groupby("rebalanced_shard")["size"].sum()
    assert load.max() <= max(got.groupby("shard")["size"].sum().max(), 1)


WORD, LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pipeline_by_hand(rows, bench, learned):
    """(doc_id, text) that the filtering stages leave, in plain Python; rows have different ids."""
    kept = []
    for i, t in rows:
        if t and any(map(str.isalpha, t)):
            lang, score = langid.classify(t, langid._compressors(tuple(sorted(learned.items())), langid.LEVEL))
            if lang != "und" and score >= langid.MIN_MARGIN:
                kept.append((i, t))
    kept = lines_by_hand(sorted(kept))
    sets = {}
    for i, t in kept:
        w = t.translate(LOW).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = [(i, t) for i, t in kept if root[i] == i]
    windows = set()
    for _, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    out = []
    for i, t in kept:
        w = WORD.findall(t.translate(LOW))
        if not any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w))):
            out.append((i, t))
    return out


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    vocab = {"en": ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(500)], "fr": ["".join(rng.choice("ésaitnruè") for _ in range(rng.randint(2, 8))) for _ in range(500)]}
    say = lambda k, n: " ".join(rng.choices(vocab[k], k=n))
    base, block, leak = say("en", 90), "\n".join(say("en", 6) for _ in range(8)), say("fr", 14)
    texts = [say(k, rng.randint(8, 150)) for k in ("en", "fr") * 20] + [base, base, base + " extra", None, "", "12 34", leak + " " + say("fr", 60)]
    texts += [say("en", 10) + "\n" + block + "\n" + say("en", 10) for _ in range(4)]
    rows = [(i, t, "fr" if t and "é" in t else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema, bench = "doc_id long, text string, lang string, source string, n_chars long", [(1, leak), (2, None)]
    for name, data, kind in (("documents", rows, schema), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    learned = langid.fit(spark.read.parquet(f"{d}/documents.parquet").where(langid.remainder() != 2).select("text", "lang"))
    want = pipeline_by_hand([(i, t) for i, t, *_ in rows], bench, learned)
    assert len(want) <= len(rows) - 6 and {40} <= {i for i, _ in want} and 46 not in {i for i, _ in want}
    done = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, done, d)
        assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(pairs(done)) == want
    packed = corpus_pipeline.run(spark, d).toPandas()
    tok = Tokenizer.from_file(q.tokenizer_path())
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_on_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that are said once and then once more in the same row of the table"
    for k, rows in enumerate(([], [(None, text, "en", None, None)] * 3 + [(1, None, None, None, None)] * 2 + [(10 + k, f"quite other words: {chr(97 + k) * 9} and so on", "en", None, None) for k in range(6)])):
        d = str(tmp_path / str(k))
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert "sequence_id" in got.columns and got.count() == (0 if k == 0 else 7)


def test_empty_tables_of_the_other_inputs(spark, docs):
    assert ann.search_hundredths(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quality.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    found = decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert found.where("contaminated").count() == 0 and found.count() == docs.count()


def test_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    rows = [(None, long), (None, long), (2, long.replace("w7 ", "v7 ")), (3, "w1 w2")]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(long.split())
    assert [r["n_words"] for r in lm.score(wide).collect() if r["doc_id"] is None] == [n, n]
    assert [(r["n_words"], r["n_removed"]) for r in phrases.summary(wide).collect() if r["doc_id"] is None] == [(n, n)] * 2
    assert {r["component_id"] for r in ngram_join.classes(wide).collect() if r["doc_id"] != 3} == {2}
    bench = spark.createDataFrame([(1, " ".join(long.split()[-12:]))], "item_id long, text string")
    assert [r["n_hit"] for r in decontam.decontaminate(wide, bench).collect() if r["doc_id"] is None] == [12, 12]
    assert quality.weights(wide, np.zeros(1 << 4, np.float32)).count() == 4 and sharding.shard_documents(wide).count() == 4
    same = "say it again " * 60_000
    again = spark.createDataFrame([(1, same)], "doc_id long, text string")
    assert [(r["n_words"], r["n_removed"]) for r in phrases.summary(again).collect()] == [(180_000, 180_000)]
