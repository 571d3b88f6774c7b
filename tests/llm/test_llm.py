"""The training-data operators against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tagloom.llm")

from tagloom.llm import common, decontam, linededup, media, packing, secrets, sharding, simhash, suffix, tokens, toxicity  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, slot string, row string, key string"


def table(spark, texts, ids=None, partitions=3):
    """Documents with extra columns whose names clash with those of operators."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", "z") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, KIND).repartition(partitions)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", " \t\n", "a", "one two three", "é🦀\0x", "same text here", "same text here", "x" * 300_000, "word " * 20_000]


def test_sharding(spark):
    rng = random.Random(1)
    texts = EDGE + [words(rng, rng.randrange(60)) for _ in range(500)]
    ids = [None, 3, 3, *range(4, len(texts) + 1)]
    got = [r.asDict() for r in sharding.byte_shards(table(spark, texts, ids), 7).collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts)
    )
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in order), key=lambda i: (i is not None, i or 0))
    total, before, slots = sum(r["size"] for r in got), 0, Counter()
    for r in order:
        assert r["shard"] == min(6, (2 * before + r["size"]) * 7 // (2 * total)) and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]
    assert sharding.byte_shards(table(spark, [])).count() == 0


def test_best_bounds():
    rng = random.Random(2)

    def cost(lengths, counts, bounds):
        return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

    from itertools import combinations

    for _ in range(200):
        lengths = sorted(rng.sample(range(40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)
        least = min(cost(lengths, counts, [*c, lengths[-1]]) for j in range(min(k, len(lengths))) for c in combinations(lengths[:-1], j))
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) <= k and cost(lengths, counts, bounds) == least
    assert packing.best_bounds([], [], 3) == []


def test_packing(spark):
    rng = random.Random(3)
    texts = EDGE + [words(rng, rng.randrange(90)) for _ in range(300)]
    got = [r.asDict() for r in packing.pack(table(spark, texts), 4, 200).collect()]
    assert {r["doc_id"]: r["length"] for r in got} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    for bucket in {r["bucket"] for r in got}:
        own = sorted((r for r in got if r["bucket"] == bucket), key=lambda r: (r["batch"], r["slot"]))
        upper = own[0]["bucket_length"]
        each = max(1, 200 // max(1, upper))
        assert all(r["bucket_length"] == upper and r["padding"] == upper - r["length"] >= 0 for r in own)
        assert [(r["batch"], r["slot"]) for r in own] == [divmod(i, each) for i in range(len(own))]
        assert [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    assert packing.pack(table(spark, [])).count() == 0


def test_bins(spark):
    rows = spark.range(0, 300_000, 7).select("id", packing.bin_of(F.col("id"), 1000).alias("b"))
    assert rows.where("b < id or (id <= 1000 and b != id) or b > id * 1.002 + 1").count() == 0


def test_packing_of_very_long_texts(spark):
    lengths = [70_001, 70_010, 90_001, 90_002]
    got = {r["length"]: r for r in packing.pack(table(spark, ["w " * n for n in lengths]), buckets=3).collect()}
    assert [got[n]["bucket_length"] for n in lengths] == [70_001, 70_010, 90_002, 90_002]
    assert [got[n]["padding"] for n in lengths] == [0, 0, 1, 0]


def test_tokens(spark):
    spm, P = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    library = spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = list("abehto th▁\n\t  éüñ日本龘\x00ａ🦀　\xa0_-=.,019<>s/")
    texts = EDGE + ["<s> </s> <0x0A>", "a" * 999, " " * 333, "▁▁ ▁"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    got = {r["doc_id"]: r for r in tokens.token_counts(table(spark, texts), path, 50).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50)
    assert tokens.token_counts(table(spark, []), path).count() == 0


def test_tokens_of_unspaced_texts():
    """Long pre-tokens: random, periodic and mixed, by the library's counts and time."""
    import string
    import time

    spm, P = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    library, merges, rng = spm.SentencePieceProcessor(model_file=path), tokens.load(path), random.Random(41)
    pick = lambda signs, n: "".join(rng.choices(signs, k=n))
    kinds = ["ab", "etaoinshrdlu", "-=*_#.", string.ascii_lowercase, string.ascii_letters + string.digits]
    texts = [pick(rng.choice(kinds), rng.randrange(50, 400)) for _ in range(1500)] + [pick(rng.choice(kinds), rng.randrange(1, 7)) * rng.randrange(9, 200) for _ in range(1000)]
    assert tokens.count_tokens(texts, merges).tolist() == [len(x) for x in library.encode(texts)]
    for text in [pick(string.ascii_lowercase, 1_000_000), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300_000)), "a" * 500_000 + "ab" * 200_000 + "=" * 99_999]:
        began = time.time()
        n = tokens.count_tokens([text], merges)[0]
        ours, began = time.time() - began, time.time()
        assert n == len(library.encode(text)) and ours < 20 * (time.time() - began) + 1


def brute_cover(rows, n):
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        cut = [False] * len(data)
        for s in range(len(data) - n + 1):
            w = data[s : s + n]
            if w in seen:
                cut[s : s + n] = [True] * n
            seen.add(w)
        out.append(cut)
    return out


def removed(cut):
    return sum(cut), sum(c and not b for b, c in zip([False, *cut], cut))


@pytest.mark.parametrize("length, gram", [(100, 32), (12, 5), (20, 20)])
def test_suffix_dedup(spark, length, gram):
    rng = random.Random(length)
    shared = [words(rng, 40, 30) for _ in range(6)]
    texts = [None, "", "a" * 450, "a" * 450, "ab" * 200, "é日🦀" * 60, "same " * 50, "same " * 50]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randrange(10, 220)])
            else:
                parts.append(words(rng, rng.randrange(1, 30), 2000))
        texts.append(" ".join(parts))
    texts += texts[20:30]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in suffix.dedup_suffixes(table(spark, texts), length, gram).collect()}
    for (i, text), cut in zip(rows, brute_cover(rows, length)):
        data = (text or "").encode()
        kept = bytes(b for b, c in zip(data, cut) if not c)
        r = got[i]
        assert (r["n_bytes"], (r["n_removed"], r["n_spans"])) == (len(data), removed(cut)), i
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_edges(spark):
    assert suffix.dedup_suffixes(table(spark, [])).count() == 0
    rng = random.Random(9)
    text = words(rng, 60)
    # a row that comes twice is one document; a null id comes first
    got = suffix.dedup_suffixes(table(spark, [text, text, text], [5, 5, None])).select("doc_id", "n_removed").collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (5, len(text)), (5, len(text))]
    long = words(rng, 30_000, 10**9)  # several pieces, repeated across their borders
    got = {r["doc_id"]: r for r in suffix.dedup_suffixes(table(spark, [long, "x" * 50 + long[: len(long) // 2]])).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == len(long) // 2


@pytest.mark.parametrize("known", [False, True])
def test_suffix_dedup_of_a_line_that_stands_everywhere(spark, known):
    """A short line in every document, a long one in most, other surroundings."""
    rng = random.Random(42)
    line, passage = "All rights reserved, 2019 to 2024, by us", words(rng, 60)
    texts = [words(rng, 30, 10**6) + line + words(rng, 30, 10**6) + (passage if i % 3 else "") + words(rng, 9) for i in range(90)]
    frequent = suffix.find_anchors([t.encode() for t in texts])[4]
    values, counts = suffix.np.unique(frequent, return_counts=True)
    frequent = values[counts > 9] if known else None
    assert not known or len(frequent) > 3
    got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup_suffixes(table(spark, texts), frequent=frequent).collect()}
    assert got == {i: sum(cut) for i, cut in enumerate(brute_cover(list(enumerate(texts)), 100))}
    assert len(suffix.frequent_grams(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))) > 3


def test_suffix_dedup_says_what_it_cannot_do(spark):
    with pytest.raises(TypeError):
        suffix.dedup_suffixes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        suffix.dedup_suffixes(table(spark, ["a"]), length=300)


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(10)
    text = words(rng, 900).encode()
    whole = suffix.find_anchors([text], 60, 20)
    monkeypatch.setattr(suffix, "PIECE", 257)
    parts = suffix.find_anchors([text], 60, 20)
    cover = lambda a: sorted({(at, at - d) for at, near, far in zip(*a[1:4]) for d in range(near, far + 1)})
    assert cover(whole) == cover(parts) and len(cover(whole)) == len(text) - 59


def test_loser_tree():
    rng = random.Random(11)
    for _ in range(300):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 7))]
        got = list(suffix.merged([suffix.Run(*suffix.front_code(r)) for r in runs]))
        strings = [s for _, _, s in got]
        assert strings == sorted(s for r in runs for s in r)
        for a, (_, lcp, b) in zip(strings, got[1:]):
            assert lcp == suffix.common(a, b, 0)


def base_spans(text):
    out = []
    for kind, rule, least, group in [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ]:
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, text, re.A) if len(m[group]) >= least]
    rank = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[0], rank.index(s[1])))


def test_secrets(spark):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    caps = lambda n: "".join(rng.choice("ABCDEFGH0123456789") for _ in range(n))
    parts = [
        lambda: f"password={hexes(18)}", lambda: f'TOKEN = "{hexes(40)}"', lambda: f"AKIA{caps(16)}", lambda: f"AKIA{caps(9)}", lambda: "secret:token:abcdef",
        lambda: "api_key='abc'", lambda: hexes(30), lambda: hexes(23), lambda: "é🦀 " * 5, lambda: words(rng, 90), lambda: f"https://db.example.com/{hexes(3)}",
        lambda: f"client_id={caps(8)}", lambda: caps(20) + "x9" * 10, lambda: "Passwd : Zz+/_.=-9",
    ]
    texts = EDGE + [" ".join(rng.choice(parts)() for _ in range(rng.randrange(9))) for _ in range(400)]
    got = {r["doc_id"]: r for r in secrets.scan(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    linked = Counter()
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in ("assign", "access", "hex")]
        shown = r["spans"].split(",") if r["spans"] else []
        assert [x for x in shown if x.split(":")[0] in ("assign", "access", "hex")] == (said.split(",") if said else [])
        assert len(shown) == len(spans) + r["n_linked"]
        linked.update(x.split(":")[0] for x in shown)
    assert all(linked[k] for k in ("identifier", "token", "endpoint"))
    assert secrets.scan(table(spark, [])).count() == 0


def test_weak_parts_need_company(spark):
    token, access, far = "Zz9" * 12, "AKIA" + "A1" * 8, " word" * 80
    texts = [token, f"{token} {access}", f"{token}{far} {access}", "https://x.example.com/a", f"https://x.example.com/a {access} {token}", f"https://x.example.com/a {access}", f"login=someone {token}"]
    kinds = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secrets.scan(table(spark, texts)).collect()}
    assert kinds == {0: [], 1: ["token", "access"], 2: ["access"], 3: [], 4: ["endpoint", "access", "token"], 5: ["access"], 6: ["identifier", "token"]}


def bench(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_decontamination(spark):
    rng = random.Random(6)
    items = [words(rng, 30) for _ in range(20)] + ["Anna has 12 red apples and gives 5 kg of them to Bob, so 12 minus 5 kg are left over today.", None, "", "only three words", "1 2 3 4 5 6 7"]
    clean = [words(rng, 120) for _ in range(60)]
    dirty = {100 + k: clean[k] + ". " + items[k].upper() + ". " + clean[-k] for k in range(20)}
    dirty[200] = "Well. Carl has 31 red apples and gives 8 kg of them to Dora, so 31 minus 8 kg are left over today."
    dirty[201] = "A b c only, three words d e."
    free = {300: "Carl has 31 red apples and gives 8 kg of them to Dora, so 77 minus 9 kg are left over today.", 301: " ".join(items[0].split()[:18]), 302: None, 303: "", 304: "1 2 3 4 5 6 7"}
    rows = dict(enumerate(clean)) | dirty | free
    docs = table(spark, list(rows.values()), list(rows))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench(spark, items)).collect()}
    assert got == {(100 + k, k) for k in range(20)} | {(200, 20), (201, 23)}
    shuffled = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench(spark, items), broadcast_rows=0).collect()}
    assert shuffled == got
    left = decontam.decontaminate(docs, bench(spark, items))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(rows) - set(dirty)
    assert decontam.leaks(table(spark, []), bench(spark, items)).count() == 0
    assert decontam.leaks(docs, bench(spark, [])).count() == 0


def test_items_that_say_too_little(spark):
    items = ["yes", "Paris", "1 2 3 4 5 6 7", "a short answer", "Where do the brown bears sleep in winter?", None]
    docs = table(spark, ["He said yes and then left for Paris.", "1 2 3 4 5 6 7", "that was a short answer.", "where do the BROWN bears sleep in winter"])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench(spark, items)).collect()} == {(2, 3), (3, 4)}
    assert {r["item_id"] for r in decontam.unmatchable(bench(spark, items)).collect()} == {0, 1, 2, 5}


def test_canonical(spark):
    docs = table(spark, ["The cat saw Anna. She ran 3.5 km, then 7 miles at 20%! NOT Paris"])
    row = decontam.canonical(docs).select("__t", decontam.signs().alias("c")).first()
    assert " ".join(row["c"]).replace("\x01", "#") == "the cat saw #p she ran #n #u then #n #u at #n #u not #p"
    assert [t[2:] for t in row["__t"] if t[0] == "\x01"] == ["anna", "3.5", "km", "7", "miles", "20", "percent", "paris"]


def test_names_that_begin_sentences(spark):
    items = ["A shop sells 12 red apples to Anna for lunch. Bob buys 5 more green pears there. How many pieces of fruit did the shop sell to them?"]
    leaked = "A shop sells 31 red apples to Dora for lunch. Carl buys 8 more green pears there. How many pieces of fruit did the shop sell to them?"
    twice = "Note: a shop sells 31 red apples to Dora for lunch. Then Carl buys 8 more green pears there. How many pieces of fruit did the shop sell to them?"
    other = "A shop sells 31 red apples to Dora for lunch. Nobody eats so much bread at home. How many loaves of bread did the bakery bring to them?"
    docs = table(spark, [leaked, items[0], twice, other])
    got = {r["doc_id"]: r for r in decontam.leaks(docs, bench(spark, items)).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0]["n_matched"] == got[0]["n_windows"] and got[0]["n_consistent"] == got[0]["n_slots"]


def brute_chunks(text, window=2, divisor=3):
    lines = text.split("\n")
    g = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % linededup.PRIME for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        total, power = g[i], 1
        for back in range(1, window):
            power = power * 31 % linededup.PRIME
            total += (g[i - back] if i >= back else 0) * power
        if total % linededup.PRIME % divisor == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_line_dedup(spark, weak):
    rng = random.Random(7)
    blocks = [[words(rng, 6) for _ in range(rng.randrange(3, 9))] for _ in range(8)]
    texts = [None, "", "\n\n\n\n\n\n\n", "a\nb\nc\nd\ne\nf"]
    for _ in range(80):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(blocks) if rng.random() < 0.6 else [words(rng, 5) for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join(lines))
    key = (lambda t: F.crc32(t.cast("binary")) % 5) if weak else F.xxhash64
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs, key=key, report=True).collect()}
    assert set(docs.columns) < set(linededup.dedup_lines(docs, report=True).columns)
    seen, hits = set(), 0
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        left, gone = [], 0
        for chunk in brute_chunks(t):
            if len(chunk) > 1 and tuple(chunk) in seen:
                gone += len(chunk)
                hits += 1
            else:
                left += ["\n".join(chunk)]
                if len(chunk) > 1:
                    seen.add(tuple(chunk))
        assert got[i]["text"] == "\n".join(left), i
        assert (got[i]["n_lines"], got[i]["n_removed_lines"], got[i]["n_chars"]) == (len(t.split("\n")), gone, len("\n".join(left)))
    assert hits > 20
    assert linededup.dedup_lines(table(spark, [])).count() == 0


def test_clashing_names(spark, tmp_path):
    """Columns named like the operators' own, or oddly, come back as they were."""
    names = ["__row", "__all", "__drop", "__lines", "__marks", "__chunks", "user", "row", "drop", "kept", "cut", "a`b", "a.b", "__toxic", "__id", "__score", "__end"]
    text = "\n".join(words(random.Random(8), 5) for _ in range(12))
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([text, text, "other", None])]
    quoted = ", ".join(f"{common.quoted(n)} string" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {quoted}")
    marks = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks, F.lit(True))
    with pytest.raises(ValueError):
        toxicity.scored(docs, lexicon)
    for got, ids in [
        (linededup.dedup_lines(docs), {0, 1, 2, 3}), (simhash.keep_one(docs), {0, 2, 3}), (decontam.decontaminate(docs, bench(spark, ["nothing of the kind here"])), {0, 1, 2, 3}),
        (toxicity.scored(docs, lexicon, "score").drop("score"), {0, 1, 2, 3}),
    ]:
        assert got.columns == docs.columns
        found = {r[0]: r for r in got.collect()}
        assert set(found) == ids and all(tuple(found[i][2:]) == rows[i][2:] for i in ids)


def test_line_dedup_of_very_many_lines(spark):
    import time

    text = "\n".join(f"line {i}" for i in range(200_000))
    began = time.time()
    got = {r["doc_id"]: r for r in linededup.dedup_lines(table(spark, [text, text]), report=True).collect()}
    assert got[0]["n_removed_lines"] == 0 and got[1]["n_removed_lines"] > 150_000
    assert time.time() - began < 30


def test_line_dedup_repeated_rows(spark):
    text = "\n".join(words(random.Random(8), 5) for _ in range(12))
    got = linededup.dedup_lines(table(spark, [text, text], [4, 4]), report=True).collect()
    assert [r["n_removed_lines"] for r in got] == [0, 0]


def brute_fingerprint(text, width):
    from xxhash import xxh64_intdigest

    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(items, linked):
    above = {i: i for i in items}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in items:
        for j in items:
            if i < j and linked(i, j):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i: top(i) for i in items}


def test_simhash(spark):
    rng = random.Random(12)
    texts = EDGE[:8] + [words(rng, 80) for _ in range(40)]
    for k in range(8, 30):
        parts = texts[k].split()
        for _ in range(rng.randrange(1, 4)):
            parts[rng.randrange(len(parts))] = "new"
        texts.append(" ".join(parts).upper() if k % 2 else " ".join(parts))
    texts += texts[20:25]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    fps = [brute_fingerprint(t or "", 4) for t in texts]
    wanted = groups_of(range(len(texts)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i, fp in enumerate(fps):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", wanted[i])
    assert len(set(wanted.values())) < len(texts) - 8
    assert simhash.near_groups(table(spark, [])).count() == 0


def test_components_says_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(chain, rounds=1)


def test_shards_are_dealt_anew(spark):
    """Shards that are too large or take too long go by more blocks and lose no link."""
    rng = random.Random(43)
    values = {rng.getrandbits(20) | 0xABC << 50 for _ in range(700)}
    values = sorted(values | {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in list(values)[:300]})
    signed = lambda v: v - (v >> 63 << 64)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    wanted = groups_of(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for options in ({}, {"most": 200, "last": 7}, {"largest": 50, "last": 7}):
        found = simhash.components(simhash.near_links(fps, 2, 4, **options)).collect()
        roots = {r["node"]: r["root"] for r in found}
        sets, brute = defaultdict(set), defaultdict(set)
        for v in values:
            sets[roots.get(signed(v), signed(v))].add(v)
            brute[wanted[v]].add(v)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, brute.values()))
    assert simhash.tree_links(values, 2, most=100) is None
    assert [simhash.blocks_for(n, 4) for n in (0, 10**8, 10**9, 10**10)] == [6, 6, 7, 8]


@pytest.mark.parametrize("spread", [2, 5, 9])
def test_bk_trees(spark, spread):
    """Dense and chained clusters: every component, without every pair."""
    rng = random.Random(spread)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values)[:10]:
        for _ in range(40):
            x = v
            for _ in range(rng.randrange(1, spread + 1)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
            v = x if rng.random() < 0.3 else v
    values = sorted(values)
    wanted = groups_of(values, lambda a, b: (a ^ b).bit_count() <= 4)
    links = simhash.tree_links(values, 4)
    assert len(links) == len(values) - len(set(wanted.values())) and all((a ^ b).bit_count() <= 4 for a, b in links)
    signed = lambda v: v - (v >> 63 << 64)
    found = simhash.components(simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fp long")))
    sets = defaultdict(set)
    for r in found.collect():
        sets[r["root"]].add(r["node"])
    brute = defaultdict(set)
    for v, root in wanted.items():
        brute[root].add(signed(v))
    assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in brute.values() if len(s) > 1)


def test_keep_one(spark):
    rng = random.Random(13)
    texts = [words(rng, 60) for _ in range(10)]
    docs = table(spark, texts + texts[:4] + texts[:1], [*range(10), 20, 21, 22, 23, 0])
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(10))
    # copies with some other words, and texts that merely share a half
    whole = [words(rng, 300, 10**6) for _ in range(12)]
    near = [" ".join("new" if i % 100 == k else w for i, w in enumerate(t.split())) for k, t in enumerate(whole)]
    half = [" ".join(t.split()[:150]) + " " + words(rng, 150, 10**6) for t in whole]
    left = simhash.keep_one(table(spark, whole + near + half))
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(12), *range(24, 36)]
    assert simhash.keep_one(table(spark, [None, "", " ", "a", "A"])).count() == 2 and simhash.keep_one(table(spark, [])).count() == 0


def jaccard_groups(texts, width=5, similarity=0.8):
    """The first of each group that pairs of that similarity join, by brute force."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    alike = lambda i, j: (both := len(sets[i] & sets[j])) >= similarity * (len(sets[i]) + len(sets[j]) - both)
    return {i for i, root in groups_of(range(len(texts)), alike).items() if i == root}, sum(alike(i, j) for i in range(len(texts)) for j in range(i))


def test_keep_one_dense(spark):
    """Variants that only their base joins, and that meet each other first."""
    rng = random.Random(16)
    base = words(rng, 304, 10**6)
    texts = []
    for _ in range(120):
        parts = base.split()
        for k in rng.sample(range(5, 300), 5):  # apart or not: about 0.85 to the base
            parts[k] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(parts))
    texts.insert(70, base)
    wanted, _ = jaccard_groups(texts)
    assert len(wanted) < len(texts) / 4
    assert {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()} == wanted


def test_keep_one_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.86 and a little less, of all lengths."""
    rng = random.Random(17)
    texts = []
    for _ in range(150):
        n = rng.randrange(60, 400)
        parts = words(rng, n, 10**6).split()
        other = list(parts)
        for k in range(max(1, round(n * rng.uniform(0.04, 0.066)) // 5)):  # runs of five words, so that shingles go by nine
            at = rng.randrange(n - 4)
            other[at : at + 5] = words(rng, 5, 10**6).split()
        texts += [" ".join(parts), " ".join(other)]
    wanted, pairs = jaccard_groups(texts)
    assert 40 < pairs < 140
    assert {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()} == wanted


def fingerprinted(rng):
    """Texts in groups of near copies, copies with a word repeated, and odd ones."""
    texts = [None, "", "a", "A", "one two three", "one two three"]
    for _ in range(25):
        parts = words(rng, rng.randrange(150, 900), 10**6).split()
        for _ in range(rng.randrange(1, 6)):
            other = list(parts)
            other[rng.randrange(len(parts))] = f"v{rng.randrange(10**6)}"
            texts += [" ".join(other)] * rng.randrange(1, 3)
    texts += [texts[20] + " end", "r s t u v w " * 30, "r s t u v w " * 31]
    rng.shuffle(texts)
    return texts


def test_tree_pairs(spark):
    """They join texts just as brute force over all fingerprints of op10 does."""
    texts = fingerprinted(random.Random(44))
    marks = [simhash.fingerprint(t or "") for t in texts]
    bits = lambda i, j: ((marks[i] ^ marks[j]) & (1 << 64) - 1).bit_count() <= 4
    wanted = groups_of(range(len(texts)), bits)
    whole = simhash.prefixes(table(spark, texts).select("doc_id", "text"), 5, 0.8)
    rows = whole.select("doc_id", "fp", "mark").collect()
    assert {r["doc_id"]: r["mark"] for r in rows} == dict(enumerate(marks))
    assert {r["doc_id"]: f"{r['mark'] & (1 << 64) - 1:016x}" for r in rows} == {r["doc_id"]: r["fingerprint"] for r in simhash.near_groups(table(spark, texts)).collect()}
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.tree_pairs(whole.select("fp", "mark"))).collect()}
    got, brute = defaultdict(set), defaultdict(set)
    for r in rows:
        got[roots.get(r["fp"], r["fp"])].add(r["doc_id"])
        brute[wanted[r["doc_id"]]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute.values())) and len(brute) < len(texts) / 2
    assert simhash.tree_pairs(whole.select("fp", "mark").limit(0)).count() == 0


def test_near_dedup_goes_by_bk_trees(spark, tmp_path, monkeypatch):
    """The pipeline's stage searches the trees with every text's fingerprint, and joins
    by the links they give; the result is that of brute force."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = fingerprinted(random.Random(45))
    searched, joined = [], []
    links, held = simhash.near_links, simhash.verified

    def near_links(fps, *more):
        searched.append({r["fp"] for r in fps.collect()})
        return links(fps, *more)

    def verified(pairs, *more):
        found = held(pairs, *more)
        joined.append(found.count())
        return found

    monkeypatch.setattr(simhash, "near_links", near_links)
    monkeypatch.setattr(simhash, "verified", verified)
    left = pipeline.near_dedup(spark, table(spark, texts), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == jaccard_groups([t or "" for t in texts])[0]
    assert searched == [{simhash.fingerprint(t or "") for t in texts}]
    assert joined[0] > 20 and joined[0] > sum(joined[1:])


def test_fold():
    assert toxicity.fold("1d10t, ІDІОТ! m0r0n### é ｓｃｕｍ 1000 a$$hat") == " idiot idiot moron e scum asshat "


def test_toxicity(spark):
    rng = random.Random(14)
    bad = ["idiot", "moron", "Wickler"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        parts = words(rng, rng.randrange(5, 60)).split()
        if toxic:
            for _ in range(1 + len(parts) // 20):
                parts.insert(rng.randrange(len(parts)), rng.choice(bad) + rng.choice(["", "ung", ","]))
        texts.append(" ".join(parts))
        labels.append((i, int(toxic)))
    docs = table(spark, texts + [None, "", "trash can"])
    marks = spark.createDataFrame(labels + [(0, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks, toxicity.fold_of() != 0)
    got = {r["doc_id"]: r["__score"] for r in toxicity.scored(docs, lexicon).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert all(got[i] < 0.5 for i in (600, 601, 602))
    assert toxicity.scored(docs, lexicon).columns == [*docs.columns, "__score"]
    hidden = toxicity.fold("some m0rоn words")
    assert lexicon.score("some m0rоn words") >= 0.5, hidden
    assert lexicon.score("sore loser") < 0.5
    assert toxicity.learn(docs, marks.where("toxic = 0"), F.lit(True)).score("idiot") < 0.5
    assert toxicity.scored(table(spark, []), lexicon).count() == 0


def test_media(spark):
    texts = EDGE + ["x" * 64, "y" * 63, "z" * 65]
    got = {r["doc_id"]: r for r in media.text_media(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.samples(stored)))
        assert media.samples(stored).tobytes() == payload and r["caption"] == f"{len(data)} bytes"
    assert media.text_media(table(spark, [])).count() == 0


def test_interleaved(spark):
    a, b, c = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c"))
    html = f"""<html><head><title>no</title><script>var t="</p>";</script></head><body><nav>no</nav><p>One <b>two</b><p>Three
      <img src="sha256:{a}" alt="first"> four</p><figure><img data-sha256="{b}" src="x.png"><figcaption>The <i>second</i></figcaption></figure>
      tail &amp; end<img src="other.png"><img src="sha256:{c}"></body>"""
    items = media.parse(html)
    assert [(i["pos"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [
        (0, "text", "One two", None), (1, "text", "Three", None), (2, "media", a, "first"), (3, "text", "four", None),
        (4, "media", b, "The second"), (5, "text", "tail & end", None), (6, "media", None, None), (7, "media", c, None),
    ]
    pages = spark.createDataFrame([(1, html), (1, html), (2, None), (3, "")], "page_id long, html string").select(F.monotonically_increasing_id().alias("k"), "*")
    table_ = spark.createDataFrame([(a, b"A"), (b, b"B"), (b, b"B")], "digest string, media binary")
    sequence = media.sequences(pages, "k", F.col("html"))
    whole = [r["items"] for r in media.gather(media.resolve(sequence, "k", table_), "k").collect()]
    assert len(whole) == 2
    for found in whole:
        assert [(i["pos"], i["kind"], i["caption"]) for i in found] == [(i["pos"], i["kind"], i["caption"]) for i in items]
        assert [bytes(i["media"]) if i["media"] is not None else None for i in found] == [None, None, b"A", None, b"B", None, None, None]


def test_shared_folder(spark):
    at = common.shared_dir(spark)
    assert at == spark.conf.get("spark.checkpoint.dir")
    df = common.materialize(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:")
    before = common.written(spark)
    more = common.materialize(spark.range(3))
    common.release(spark, [t for t in common.written(spark) if t not in before])
    assert common.written(spark) == before and df.count() == 5
    with pytest.raises(Exception):
        more.collect()


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Unset()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster())


def test_pipeline(spark, tmp_path):
    """Each stage's decisions take effect, and clean documents pass all of them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(15)
    clean = {i: "\n".join(words(rng, 12, 10**6) for _ in range(6)) for i in range(120)}
    items = [words(rng, 30, 10**6) for _ in range(5)]
    rows = dict(clean)
    rows |= {200 + i: clean[i].replace("w", "idiot w", 3) for i in range(40)}
    rows |= {300 + i: "Start. " + items[i] + ". " + words(rng, 20, 10**6) for i in range(5)}
    long = [words(rng, 200, 10**6) for _ in range(5)]
    rows |= {400 + i: long[i] for i in range(5)} | {500 + i: long[i] + " end" for i in range(5)} | {600: long[0]}
    docs = table(spark, list(rows.values()), list(rows))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(200 <= i < 300)) for i in rows if i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.col("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = common.materialize(docs)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    ids = set(rows)
    assert kept["toxicity"] == ids - set(range(200, 240))
    assert kept["line_dedup"] == kept["toxicity"]
    assert kept["near_dedup"] == kept["line_dedup"] - {500 + i for i in range(5)} - {600}
    assert kept["decontamination"] == kept["near_dedup"] - {300 + i for i in range(5)}
    assert kept["packing"] == kept["decontamination"] >= set(clean)
    got = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == kept["packing"]
