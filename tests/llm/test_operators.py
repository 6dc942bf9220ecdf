"""The text operators on awkward rows and against brute force."""

import bisect
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import anchors, fingerprint, language_id, line_dedup, mixing, near_dup, packing, quality, queries, shingles, suffix_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- language identification ---


def test_language(spark):
    en = ["the cat is on the table and the dog", "where is the house of the man", "and this is what they have"] * 5
    fr = ["le chat est sur la table et le chien", "une maison dans la rue avec des gens", "il est pour les enfants"] * 5
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(100 + i, t, "fr") for i, t in enumerate(fr)]
    model = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    test = spark.createDataFrame([(1, "the cats"), (2, "les chiens"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    got = by_id(language_id.predict(test, model, [F.col("doc_id")]))
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_backs_off_to_shorter_grams():
    model = language_id.Model({"a": [("zebra", 5)], "b": [("quick", 5)]}, {"a": 1, "b": 1}, language_id.Bounds())
    say = model.predictor()
    assert say("zebras")[0] == "a" and say("quickly")[0] == "b" and say("z")[0] == "a"


def test_language_without_labels(docs, empty):
    model = language_id.fit(empty.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = language_id.predict(docs, model, [F.col("doc_id")]).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language_id.predict(empty, model, [F.col("doc_id")]).count() == 0


# --- URL filters ---

RULES = queries.URL_RULES


def test_url_rules(spark):
    urls = {1: "http://a.example.org/es/x", 2: "http://Example.ORG/en/12", 3: "http://x.com/fr/1", 4: "http://x.com/de/1", 5: "http://x.net/", 6: None, 7: "nothing", 8: "http://notorg/", 9: "http://z.org", 10: "http://badexample.org/es/q?x#y"}
    pages = spark.createDataFrame([(k, u, None) for k, u in urls.items()], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2] is None and got[9][1:3] == ("", None) and got[10][1:] == ("/es/q", "org/", "allow")


def test_url_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.net/1", canonical.format("http://b.net/1")), (2, "http://b.net/1", refresh.format("http://c.com/de/1")),  # to a blocked page
        (3, "http://d.net/1", canonical.format("/2")), (4, "http://d.net/2#top", ""), (5, "http://e.net/1", refresh.format("http://f.com/de/2")),
        (6, "http://e.net/1", canonical.format("http://g.com/fr/2")), (7, "http://h.net/1", "<link rel=stylesheet href=http://c.com/de/1>"),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got[1]["verdict"] == got[2]["verdict"] == "block"
    assert got[3]["verdict"] == "allow" and got[3]["alias_class"] == got[4]["alias_class"] is not None
    assert got[5]["verdict"] == "allow"  # an explicit allow in the class has precedence
    assert got[7]["verdict"] == "allow" and got[7]["alias_class"] is None


# --- toxicity ---


def test_toxicity(spark):
    clean = [f"a calm note about topic{i} and weather{i % 5}" for i in range(60)]
    toxic = [f"you pathetic idiot topic{i} you are trash" for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    test = spark.createDataFrame([(1, "what an idiot , pathetic"), (2, "calm weather"), (3, None), (4, "")], "doc_id long, text string")
    got = by_id(toxicity.score(test, model, [F.col("doc_id")]))
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == got[3]["predicted"] == got[4]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(model.accuracies) == len(model.voters) == len(model.discounts)


def test_toxicity_without_labels(docs, empty):
    model = toxicity.fit(docs, empty.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["score"] for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()} == {0.0}


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    fire = lambda p, q: (rng.random(2000) < np.where(y, p, q)).astype(float)
    one = fire(0.6, 0.02)
    votes = np.stack([one, one, one, fire(0.6, 0.02), fire(0.5, 0.02)], axis=1)
    p, rates, discount = toxicity._label_model(votes, 0.2, np.full(5, 0.8))
    assert discount[0] > 2 * discount[3]
    assert ((p > 0.5) == y).mean() > 0.9


# --- fingerprints ---


def test_fingerprints(spark, docs):
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprint.compare(rows, blocks=8).collect()
    text = sorted(((r["doc_id"], r["text"]) for r in rows.collect()))
    want = {}
    for i, (d, t) in enumerate(text):
        n, nxt = len(t) // 2, text[(i + 1) % len(text)][1]
        want.setdefault(d, set()).add(hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest())
    prints = collections.defaultdict(set)
    for r in got:
        assert r["edited_sha256"] in want[r["doc_id"]] and r["n_chars"] == len(dict(text)[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[dict(text)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_follow_order_and_occurrence(spark):
    w = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(w), 2: " ".join(w[:390] + ["x"] * 10), 3: " ".join(w[200:] + w[:200]), 4: " ".join(["a b c d e f"] * 50), 5: " ".join(["a b c d e f"] * 51)}
    f = by_id(fingerprint.sketch(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "text", "f", sketches=64))
    like = lambda a, b: np.mean([x == y for x, y in zip(f[a]["f"], f[b]["f"])])
    assert like(1, 2) > 0.7  # few edits
    assert 0.2 < like(1, 3) < 0.9 and like(1, 3) < like(1, 2)  # the same k-mers in another order
    assert like(4, 5) > 0.5  # repeats are numbered, not collapsed
    assert like(1, 4) == 0


# --- mixing ---


def test_targets_water_filling(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 10, None: 40}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2]))
    left, free, want = 1200.0, set(order), {}
    while True:  # cut what is above, share the rest again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert all(got[s] == pytest.approx(want[s]) for s in order)


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs, block_rows=4).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert sorted(map(str, mixing.mix(docs, block_rows=4).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0
    kept = mixing.mixed_documents(docs, block_rows=4)
    assert kept.columns == docs.columns and kept.count() == sum(r["copies"] for r in rows)


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 3}") for i, n in enumerate(rng.integers(1, 60, 3000))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=100).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k"), F.sum(F.col("size") * F.col("target") / F.col("source_size")).alias("e")).collect()
    assert all(abs(r["k"] - r["t"]) <= 60 for r in got)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(5)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    out = mixing.flight(p.copy(), size, rng.random(500))
    assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


# --- line dedup ---


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r[-1] for r in line_dedup.dedup(docs, min_words=3).collect()}
    line = "a common line that every site has"
    assert got[10]["n_removed"] == 0 and line in got[10]["text"]  # the first keeps it
    assert all(got[i]["n_removed"] == 1 and line not in got[i]["text"] for i in range(11, 34))
    assert got[0]["text"] is None and got[1]["text"] == "" and not got[1]["emptied"]
    assert line_dedup.dedup(docs, min_sites=13)  # above all sites: nothing goes
    assert line_dedup.dedup(docs, min_sites=13).where("__lines.n_removed > 0").count() == 0
    assert line_dedup.dedup(empty).count() == 0
    assert line_dedup.clean(docs).columns == docs.columns


def test_line_dedup_near_threshold_is_exact(spark):
    rows = [(i, f"line of group {g} here", f"s{i}") for g, n in enumerate((9, 10, 11)) for i in range(n)]
    found = line_dedup.boilerplate(spark.createDataFrame([(100 * g + i, t, s) for i, (g, (_, t, s)) in enumerate((int(r[1].split()[3]), r) for r in rows)], "doc_id long, text string, source string"))
    assert sorted(r["sites"] for r in found.collect()) == [10, 11]


# --- suffix array ---


def test_maximal_repeats():
    assert suffix_dedup.maximal_repeats(b"xabcyabcz", 3) == [(3, [1, 5])]
    assert suffix_dedup.maximal_repeats(b"aaaa", 2) == [(2, [0, 1, 2]), (3, [0, 1])]
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 100, 200).astype(np.uint8))
    for length, starts in suffix_dedup.maximal_repeats(data, 4):
        piece = data[starts[0] : starts[0] + length]
        every = [i for i in range(len(data)) if data[i : i + length] == piece]
        assert every == starts and len(every) > 1
        assert len({data[i + length : i + length + 1] for i in every}) > 1 and (0 in every or len({data[i - 1] for i in every}) > 1)


def brute_windows(texts, length):
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup_against_brute_force(spark, hot):
    rng = np.random.default_rng(2)
    share = ["".join(rng.choice(list("abcdé "), 150)) for _ in range(4)]
    texts = ["".join(rng.choice(list("abcdé "), rng.integers(0, 80))) + share[i % 4][: rng.integers(60, 150)] + "".join(rng.choice(list("abc"), 30)) for i in range(40)]
    texts += [texts[3], "", "z" * 400, "xy" * 200, texts[5] + texts[6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(suffix_dedup.dedup(df, hot=hot))
    for i, want in enumerate(brute_windows(texts, 100)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want, i


def test_suffix_dedup_awkward_rows(docs, empty):
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    assert suffix_dedup.dedup(empty).count() == 0


def test_equal_windows_name_equal_anchors():
    rng = np.random.default_rng(4)
    core = bytes(rng.integers(97, 123, 300).astype(np.uint8))
    raw = b"".join([b"q" * 37, core, b"r" * 11, core])
    start, windows, anchor, content = anchors.pieces(np.frombuffer(raw, np.uint8), np.array([len(raw)]), 100, 24)
    assert windows.sum() == len(raw) - 99
    name = {}
    for s, n, a in zip(start, windows, anchor):
        for i in range(s, s + n):
            assert name.setdefault(raw[i : i + 100], a) == a


# --- quality ---


def test_quality_against_brute_force(spark, docs):
    extra = spark.createDataFrame([(90, "a b c a b c x", "en", "s1", 0, ""), (91, "l1 #\nl1 #\n\n$ %&*", "en", "s1", 0, ""), (92, " ".join(["spam"] * 80), "en", "s1", 0, "")], docs.schema)
    rows = docs.union(extra)
    got = quality.judge(rows).collect()
    assert len(got) == rows.count()
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in got:
        t = text[r["doc_id"]]
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_host_verdicts_shrink(spark):
    rows = [("big", True)] * 90 + [("big", False)] * 10 + [("one", True)] + [("good", False)] * 200 + [("fine", False)] * 150
    got = {r["host_key"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host_key string, base_failed boolean")).collect()}
    assert not got["big"]["host_passed"] and got["good"]["host_passed"]
    assert got["one"]["shrunk_rate"] < 1.0


# --- near duplicates ---


def brute_components(texts, k, percent):
    sets = {}
    for d, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts, i = [], 0
    for group in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(30, 120))]
        for _ in range(rng.integers(1, 7)):
            w = list(base)
            for j in rng.integers(0, len(w), rng.integers(0, 4)):
                w[j] = f"e{rng.integers(1000)}"
            texts.append((i, " ".join(w)))
            i += 1
    texts += [(500, None), (501, ""), (502, "Two words"), (503, "two  WORDS"), (504, "x")]
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), k=4).collect()}
    for d, (n, c) in brute_components(texts, 4, 80).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d)


def test_near_duplicates_awkward_rows(docs, empty):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {4, 0, 1, 2} <= {r["doc_id"] for r in kept.collect()} and 5 not in {r["doc_id"] for r in kept.collect()}


def test_shingles_of_long_and_many_texts():
    texts = ["a b c d e f", "", None, "A B c d", "a b", "x " * 50_000]
    got = shingles.shingle_sets(texts, 4, budget=8)
    assert [len(s) for s in got] == [3, 0, 0, 1, 1, 1]
    assert got[3][0] in got[0]
    assert [s.tolist() for s in got] == [s.tolist() for s in shingles.shingle_sets(texts, 4)]


# --- packing ---


def test_plan_is_gapless_and_tight():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 1025, 300), rng.integers(1, 50, 300))}
    used = collections.defaultdict(list)
    ranks = collections.Counter()
    for length, rank, n, first, offset in packing.plan(counts):
        assert rank == ranks[length]
        ranks[length] += n
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert ranks == collections.Counter(counts)
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    # As many sequences as best-fit decreasing over single pieces opens.
    free: list[int] = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        i = bisect.bisect_left(free, length)
        bisect.insort(free, (free.pop(i) if i < len(free) else 1024) - length)
    assert len(used) == len(free)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        assert [o for o, _ in sorted(items)] == list(np.cumsum([0] + [n for _, n in sorted(items)])[:-1])
    assert packing.pack(empty, path).count() == 0


def test_units_equal_whole_texts():
    from edgeloom.llm.tokens import encoder

    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    t, say = Tokenizer.from_file(path), encoder(path)
    for s in ["", " a", "a ", "a  b", "a\n\nb", "a \n b", "don't, I'll go.", "x1y2 3z", "é ñ中文 ok", "a b", "<|endoftext|> x", "a<|endoftext|>b c", *[f"x {a.content} y" for a in t.get_added_tokens_decoder().values()], "tab\tx", "a b c.", "!!! ??", "a.\nB,", "\0 a b", "²x ½ y"]:
        assert np.frombuffer(say(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("most", [1, 50, 1 << 17])
def test_groups_of_some_hashes_at_a_time(monkeypatch, most):
    """Groups don't depend on how many windows are sorted at once."""
    rng = np.random.default_rng(6)
    raw = np.concatenate([[0], np.tile(rng.integers(97, 100, 500), 3), rng.integers(97, 123, 300)]).astype(np.uint8)
    at = np.arange(1, len(raw) - 100)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", most)
    got = sorted(tuple(map(int, m)) for m, _ in suffix_dedup._groups(np.concatenate([raw, np.zeros(100, np.uint8)]), at, at, 100))
    known = {}
    for i, p in enumerate(at):
        known.setdefault(raw[p : p + 100].tobytes(), []).append(i)
    assert got == sorted(tuple(m) for m in known.values() if len(m) > 1)


def test_groups_of_many_windows_need_little_memory():
    import tracemalloc

    piece = np.random.default_rng(7).integers(97, 123, 175).astype(np.uint8)
    raw = np.concatenate([np.zeros(1, np.uint8), np.tile(piece, 6000), np.zeros(100, np.uint8)])
    at = (1 + 175 * np.arange(6000)[:, None] + np.arange(76)).ravel()
    tracemalloc.start()
    found = suffix_dedup._groups(raw, at, np.arange(len(at)), 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 76 and all(len(m) == 6000 for m, _ in found)
    assert most < 100e6  # all 456,000 windows at once took 136 MB
