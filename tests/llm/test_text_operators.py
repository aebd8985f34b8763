"""Operators on documents, against plain Python on small fixtures with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from duoclock.llm import bpe, langid, lines, minhash, packing, substring
from duoclock.llm.components import connected_components
from duoclock.llm.queries import TOKENIZER

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_text string, score string"


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    passage, line = " ".join(prose(rng, 70)), "A Line That Is Held By Many Documents"
    base = prose(rng, 120)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "One TWO"), (None, "no id here " + passage)]
    for i in range(10, 30):
        own = prose(rng, rng.randrange(5, 200))
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at]) + "\n" + passage + "\n\n" + (line if i % 2 else f"  {line.upper()}\v") + "\n" + " ".join(own[at:])))
    for i in range(40, 60):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(1000))
        rows.append((i, " ".join(copy)))
    rows += [(60, " ".join(base)), (61, " ".join(base)), (62, " ".join(base).upper()), (63, " ".join(prose(rng, 6000)) + " " + passage), (64, passage + " " + passage), (65, "été\x1cça ﬀ 日本 😀 " + passage)]
    rows += [rows[10], rows[12]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(spark, docs, texts, empty):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 if i is None else i)
    want = sorted((str(i), t or "", "\n".join(x for x in (t or "").split("\n") if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (-1 if i is None else i)))) for i, t in texts)
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_lines", "n_dropped", "kept_text"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["kept_text"]) for r in got) == want
    assert all(r["n_lines"] == (r["text"] or "").count("\n") + 1 and r["n_dropped"] >= 0 for r in got)
    assert sum(r["n_dropped"] for r in got) > 30
    assert lines.dedup_lines(empty).count() == 0


def brute_components(texts, k, per_cent):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if texts[i][0] is not None and texts[j][0] is not None:
                both = len(sets[i] & sets[j])
                if both and (100 * both >= per_cent * len(sets[i] | sets[j]) or texts[i][0] == texts[j][0]):
                    parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(texts):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted((-1 if n is None else n, len(s), -1 if n is None else least[find(i)]) for i, ((n, _), s) in enumerate(zip(texts, sets, strict=True)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    got = minhash.near_duplicates(docs, k=k).collect()
    plain = lambda x: -1 if x is None else x
    assert sorted((plain(r["doc_id"]), r["n_shingles"], plain(r["component_id"])) for r in got) == brute_components(texts, k, 80)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_hidden_centre(spark):
    """Copies that are like one document but not like each other all join it."""
    rng = random.Random(3)
    base = prose(rng, 200)
    rows = [(500, " ".join(base))]
    for i in range(12):
        copy = list(base)
        for j in range(4):  # each change costs five shingles of five words
            copy[16 * i + 4 * j % 16] = f"own{i}x{j}"
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=5).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 80)
    assert len({r["component_id"] for r in got}) == 1


def thue_morse(n: int) -> tuple[str, str]:
    """Two different words of n letters on which hashes that are sums of powers of an odd base modulo 2**64 agree."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_sums_of_powers_confuse(spark):
    one, other = thue_morse(2048)
    near = spark.createDataFrame([(1, f"{one} tail"), (2, f"{other} tail")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(near, k=2).collect()} == {1: 1, 2: 2}
    before, after = " ".join(f"b{i}" for i in range(30)), " ".join(f"a{i}" for i in range(30))
    rows = [(1, f"{before} {one} {after}"), (2, f"{before} {other} {after}"), (3, f"{before} {other} {after}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 61}


def test_near_duplicates_across_pivots(spark):
    """Groups with a common core: links between documents that no pivot is linked to, and none where there is none."""
    rng = random.Random(21)
    core, rows = prose(rng, 100), []
    for family in range(6):  # families are under 0.8 to each other and share many keys
        own = core + prose(rng, 28)
        for member in range(5):
            copy = list(own)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((100 * family + member, " ".join(copy)))
    rows += [(1000 + i, " ".join(core + prose(rng, 26 + i % 3))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (1, 2):
        got = minhash.near_duplicates(frame, k=k).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, k, 80)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 140)) for _ in range(60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(v == 100 for k, v in got.items() if 100 < k < 200) and got[201] == 200
    assert 0 not in got and 100 not in got


def test_substrings(docs, texts, empty):
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for p in range(len(w) - 49):
            if i is not None:
                first[tuple(w[p : p + 50])] = min(i, first.get(tuple(w[p : p + 50]), i))
    want = []
    for i, w in split:
        gone = {p + j for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for j in range(50)}
        want.append((str(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    out = substring.dedup_substrings(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "n_removed", "kept_text"]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())
    assert got == sorted(want) and sum(x[2] for x in got) > 1000
    assert substring.dedup_substrings(empty).count() == 0


def test_packing(docs, texts, empty):
    machine = Tokenizer.from_file(TOKENIZER)
    ids = {}
    for i, t in texts:
        ids[i] = [*machine.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = packing.pack(docs, TOKENIZER, group_docs=16).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = defaultdict(int)
    for i, _ in texts:
        copies[i] += 1
    assert {i: sorted(x) for i, x in covered.items()} == {i: sorted([*range(len(ids[i]))] * n) for i, n in copies.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    open_ones = sum(sum(n for _, n in parts) < 2048 for parts in sequences.values())
    assert open_ones <= -(-len(texts) // 16)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    room, want = [], []
    for item, n in enumerate(lengths):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(100)
            want.append([])
        room[at] -= n
        want[at].append((item, 0, n))
    bins = packing.first_fit_decreasing(lengths, 100)
    assert bins == want
    filled = packing.fill_up(bins, 100)
    assert sum(sum(n for *_, n in b) < 100 for b in filled) <= 1
    parts = sorted((item, start, n) for b in filled for item, start, n in b)
    for item, n in enumerate(lengths):
        at = 0
        for _, start, k in (p for p in parts if p[0] == item):
            assert start == at
            at += k
        assert at == n


def test_bpe(spark, docs, texts, empty):
    machine = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    odd = ["a", "th", " ", "  ", "\n", "'s", "'", "1", "²", "é", "ß", "日本", "٣", "\x1c", "\x85", "\xa0", "<|endoftext|>", "__", "#", "😀", "\t", "-----", "ing"]
    rows = [(i, "".join(rng.choices(odd, k=rng.randrange(14)))) for i in range(400)] + [(1000, "x" * 3000), (1001, " " * 3000 + "y"), (1002, None)]
    odd_docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame, plain in ((odd_docs, rows), (docs, texts)):
        want = []
        for i, t in plain:
            ids = machine.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(machine.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r[0]), r[1], r[2], r[3]) for r in bpe.round_trip(frame, TOKENIZER).collect()) == sorted(want)
    back = bpe.decode(bpe.encode(odd_docs, TOKENIZER), TOKENIZER).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t in rows)
    assert bpe.round_trip(empty, TOKENIZER).count() == 0


def test_equal_rows_are_dealt_evenly(spark):
    """10,000 rows of one id and text don't make one group."""
    same = spark.range(10_000).selectExpr("7L AS doc_id", "'one and the same text' AS text")
    pieces = packing.pack(same, TOKENIZER, group_docs=1000)
    groups = [r["n"] for r in pieces.where("start = 0").groupBy((pieces["sequence_id"] / (1 << 32)).cast("bigint").alias("g")).count().withColumnRenamed("count", "n").collect()]
    assert len(groups) == 10 and sum(groups) == 10_000 and max(groups) < 1200


def test_packing_of_long_runs_and_specials(spark):
    """A million spaces, a long word and special tokens, as the tokenizers library gives them."""
    machine = Tokenizer.from_file(TOKENIZER)
    texts = [" " * 1_000_000 + "y", "ab" * 50_000, "one<|endoftext|>two <|endoftext|>", "日本" * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    coded = [[*machine.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for r in packing.pack(docs, TOKENIZER).collect():
        ids = coded[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]]))


def test_bpe_of_a_long_text_without_spaces(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000)) + "日本語" * 50_000
    machine = Tokenizer.from_file(TOKENIZER)
    ids = machine.encode(text, add_special_tokens=False).ids
    row = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), TOKENIZER).first()
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoder = bpe.text_encoder(TOKENIZER)
    encoder.encode(text)
    assert encoder.chunks.held <= encoder.chunks.limit + 10_000 and max(map(len, encoder.chunks), default=0) <= bpe.LONGEST_KEPT


def test_transitions_start_anew():
    """The table stays within its limit and keeps giving what the gadgets say."""
    machine = bpe.Automaton.from_file(TOKENIZER)
    machine.table.limit = 1 << 16
    rng = random.Random(8)
    words = list({"".join(rng.choices("aeioustrnlé日", k=rng.randrange(2, 14))) for _ in range(6000)})
    assert machine.encode_words(words) == [machine.encode_word(w) for w in words]
    assert len(machine.table.keys) <= 1 << 18


def test_small_automaton():
    """All strings over a small alphabet, against merging by rank."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("aa", "b"), ("b", "b"), ("aba", "ab"), ("bb", "a"), ("aa", "aa")]
    vocab = {"a": 0, "b": 1}
    for u, v in merges:
        vocab.setdefault(u + v, len(vocab))
    machine = bpe.Automaton(vocab, [f"{u} {v}" for u, v in merges], {})

    def merged(s: str) -> list[str]:
        parts = list(s)
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 11):
        for bits in range(1 << n):
            s = "".join("ab"[bits >> i & 1] for i in range(n))
            assert machine.encode_words([s]) == [machine.encode_word(s)]
            assert [machine.labels[t].decode() for t in machine.encode_word(s)] == merged(s), s


def test_language(spark, empty):
    rng = random.Random(4)
    syllables = {"aa": ["the", "ing", "th", "er"], "bb": ["eau", "oui", "ç", "le"], "cc": ["sch", "ü", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 34 ...", "cc"), (103, "THE ing THER", None), (None, "ouieau leç", "bb"), (104, "sch" * 5000, "cc")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, score string")
    from pyspark.sql import functions as F

    found = langid.learn(docs, F.col("doc_id") % 4 != 2)
    assert sorted(found) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, found).collect()}
    for i, _, lang in rows[:60]:
        assert got[i][0] == lang and 0 < got[i][1] <= 1
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "aa" and got[None][0] == "bb" and got[104][0] == "cc"
    assert langid.learn(empty, F.lit(True)) == {}
    assert langid.predict(empty, found).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, {}).collect()} == {("und", 0.0)}
    long, short = langid.vectors(64, 3, 1).bundle(["abc abd " * 2000, "abc abd "])
    assert (long[:5] > 0).tolist() == (short[:5] > 0).tolist() or long.any()
