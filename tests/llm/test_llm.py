"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, audio, cotrain, licenses, lines, minhash, packing, sentencepieces, substrings, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words long, component_id string"


def corpus(n=60, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, and words beyond ASCII."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "naïve", "x,y", "A-B", "!!"]
    word = lambda: r.choice(vocabulary)
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        t = [word() for _ in range(r.choice([1, 3, 5, 30, 120]))]
        if i % 5 == 0:
            at = r.randrange(len(t) + 1)
            t[at:at] = passage
        if i % 7 == 3 and out:
            t = (r.choice(out)[1] or "").split()
            for _ in range(len(t) // 60):
                t[r.randrange(len(t))] = word()
        out.append((i, r.choice([" ", "\n", " \t"]).join(t), f"s{i % 3}", 5, "c"))
    out += [(n, None, None, None, None), (n + 1, "", "s", 1, "c"), (n + 2, " \n ", "s", 1, "c"), (n + 3, out[0][1], "s", 1, "c"), (n + 4, " ".join(word() for _ in range(6000)), "s", 1, "c")]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return [tuple(x) for x in df.select("doc_id", *columns).orderBy("doc_id").collect()]


# -- substrings


def covered(rows, n):
    seen, out = set(), []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if k in seen:
                gone[p : p + n] = [True] * n
            seen.add(k)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("n", [20, 40, 7])
def test_substrings(docs, rows, n):
    assert by_id(substrings.substring_dedup(docs, min_words=n), "n_words", "n_removed", "text") == covered(rows, n)


def test_substrings_levels_and_spans(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "levels", lambda n: [5, 10, 20])
    monkeypatch.setattr(substrings, "RANGE", 50)
    out = substrings.substring_dedup(docs, tidy=False).orderBy("doc_id").collect()
    for r, own, e in zip(out, sorted(rows), covered(rows, 20), strict=True):
        assert r["n_removed"] == e[2] == sum(s["length"] for s in r["removed_spans"])
        assert r["text"] == (e[3] if e[2] else own[1] or "")
        assert r["source"] == own[2] and r["component_id"] == own[4]


def test_substrings_ties(spark):
    text = " ".join(f"a{i}" for i in range(30))
    out = substrings.substring_dedup(spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in out) == [(False, 30), (False, 30), (True, 0)]


# -- near duplicates


def linked(rows):
    sets = []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_near_duplicates(docs, rows):
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == linked(rows)


def test_near_duplicates_chains(spark):
    """A chain whose ends aren't alike, groups in one bucket that a star misses, and many short texts."""
    r = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for k in range(120):
        rows.append((k, " ".join(base)))
        for _ in range(2):
            base[r.randrange(200)] = f"n{r.randrange(10**6)}"
    rows += [(1000 + k, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == linked(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """One bucket with many members of several components, as blocks of four against blocks of four."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "GROUP", 20_000)
    r = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(70):
        own = list(base)
        for _ in range(r.randrange(2, 9)):
            own[r.randrange(120)] = f"n{r.randrange(40)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == linked(rows)


def _framed(r, frame, own):
    """A page of `own` words of its own, most of them in one stretch, after a frame that others have too."""
    return " ".join([*frame, *(f"o{r.randrange(10**9)}" for _ in range(own))])


def test_near_duplicates_of_framed_pages(spark, monkeypatch):
    """Pages of one frame: with too many words of their own for a link, with few, with near copies, shared ids, repeated rows."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(12)
    frame = [f"f{k}" for k in range(80)]
    rows = [(k, _framed(r, frame, own)) for k, own in enumerate([20] * 30 + [10, 12] * 8 + [r.randrange(17, 40) for _ in range(30)])]
    for k in range(12):  # families of two to four near copies that are linked with no other
        page = _framed(r, frame, 22).split()
        for n in range(2 + k % 3):
            rows.append((200 + 10 * k + n, " ".join([*page[:-1], f"x{n}"])))
    rows += [(400, rows[3][1]), (5, rows[3][1]), (6, _framed(r, frame, 20)), (7, rows[7][1])]
    r.shuffle(rows)
    got = {(x["doc_id"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at, unlike = {}, []  # an id of several texts has the links of each: its texts as documents of their own, then joined
    for k, (i, text) in enumerate(rows):
        at[k] = i
        unlike.append((k, text))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, _, c, _ in linked(unlike):
        x, y = find(at[k]), find(at[c])
        root[max(x, y)] = min(x, y)
    assert got == {(i, find(i)) for i, _ in rows}
    assert 60 < len({find(i) for i in root}) < len(root) - 20


@pytest.mark.parametrize("copies", [1, 4])
def test_rows_of_framed_pages_grow_with_the_pages(spark, monkeypatch, copies):
    """Pages that share four fifths of their words and no link, alone or in families of near copies: no blocks against blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    made = []
    plain = minhash._in_blocks

    def counted(rows, beside):
        made.append(plain(rows, beside).count())
        return plain(rows, beside)

    monkeypatch.setattr(minhash, "_in_blocks", counted)
    for pages in (100, 400):
        r, rows = random.Random(3), []
        for k in range(pages // copies):
            page = _framed(r, [f"f{k}" for k in range(160)], 40)
            rows += [(copies * k + n, page if not n else f"{page} y{n}") for n in range(copies)]
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len({x["component_id"] for x in out}) == pages // copies
    assert sum(made) <= 1_000


def test_components(spark):
    """Against union-find: a long chain, a star with many leaves, a cycle, repeated and reversed links, a loop."""
    from millrace.llm.graph import components

    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(900, 901), (901, 902), (902, 900), (901, 900), (950, 950)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    random.Random(1).shuffle(links)
    got = components(spark.createDataFrame([*links, *links[:50]], "a long, b long")).collect()
    assert {(r["id"], r["component"]) for r in got} == {(i, find(i)) for x in links for i in x if x[0] != x[1]} and len(got) == len({r["id"] for r in got})



def test_buckets_of_one_block_are_not_counted_again(spark):
    """Only what is left of larger buckets gets new numbers of blocks."""
    kind = "key long, id long, listed boolean, outside boolean, chunks int, pchunks int"
    rows = spark.createDataFrame([(1, 1, True, False, 1, 1), (1, 2, True, True, 1, 1), *((2, k, True, k > 1, 9, 9) for k in range(300)), (3, 1, True, False, 3, 1), (3, 2, True, True, 3, 1)], kind)
    got = minhash._counted_again(minhash.saved(rows, "test_again"))
    assert {(r["key"], r["chunks"], r["pchunks"]) for r in got.collect()} == {(1, 1, 1), (2, 2, 2), (3, 1, 1)} and got.count() == 304


def test_stars_need_no_round(spark, monkeypatch):
    """Rounds end when stars are left; what was tested before was that a further round changes nothing."""
    from millrace.llm import graph

    written = []
    monkeypatch.setattr(graph, "saved", lambda df, label, own=graph.saved: written.append(label) or own(df, label))
    stars = [(7, 1), (8, 1), (1, 9), (4, 3), (5, 5)]
    got = {(r["id"], r["component"]) for r in graph.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {(1, 1), (7, 1), (8, 1), (9, 1), (3, 3), (4, 3)} and len(written) == 1
    written.clear()
    got = {(r["id"], r["component"]) for r in graph.components(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)} and len(written) == 2  # the links and one round


def test_near_duplicates_null_ids(spark):
    t = "one two three four five six"
    out = minhash.near_duplicates(spark.createDataFrame([(None, t), (4, t), (9, t), (None, "all alone here"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in out if r["component_id"] is not None) == [("3", 3, True), ("4", 4, True), ("9", 4, False), ("None", 4, False)]
    assert [r["kept"] for r in out if r["component_id"] is None] == [True]


def test_small_sets_keep_pairs_at_the_threshold():
    """Pairs of 3 of 4 shingles agree on few bins now and then; the filter before confirming must not lose them."""
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, 4, dtype=np.uint64) for _ in range(20000)]
    x, y = minhash.signatures(sets), minhash.signatures([s[:3] for s in sets])
    filled = np.array([len(np.unique(minhash.mix(s) >> np.uint64(57))) for s in sets], np.int32)
    batch = pa.record_batch({"a": pa.array(range(20000)), "b": pa.array(range(20000)), "x": minhash._binary(x), "y": minhash._binary(y), "filled": pa.array(filled)})
    assert ((x == y).sum(axis=1) < 76).any()
    assert sum(b.num_rows for b in minhash._likely(0.75)([batch])) == 20000
    assert minhash._least(0.75)[128] == 62


def test_densified_bins_agree_with_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], r.integers(0, 2**63, 1000, dtype=np.uint64)]))
    s = minhash.signatures([a, b, a[:3], np.zeros(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15
    assert len(set(s[2].tolist())) <= 3 and not s[3].any()


# -- lines


def unlined(rows, lines=3, words=8):
    """id, n_lines, n_removed, text of each row, by all runs that count."""
    seen, out = set(), []
    for i, text, *_ in rows:
        own = [] if text is None else text.split("\n")
        gone = [False] * len(own)
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                k = tuple(own[a:b])
                if (lines and b - a == lines and any(k)) or (words and len(WORDS.findall("\n".join(k))) >= words):
                    if k in seen:
                        gone[a:b] = [True] * (b - a)
                    seen.add(k)
        out.append((i, len(own), sum(gone), None if text is None else "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("words", [8, 3, None])
def test_lines(spark, words):
    r = random.Random(9)
    pool = [f"line {i}" for i in range(12)] + ["", ""] + [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate([4, 5, 6, 9, 12])]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 30))), "s", None, None) for i in range(60)]
    rows += [(80, None, None, 1, "x"), (81, "", None, 1, "x"), (82, "a\n\n\n\n\nb", None, 1, "x"), (83, pool[-1], None, 1, "x"), (84, pool[-1], None, 1, "x"), (85, pool[0], None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_words long, gone string").repartition(3)
    assert by_id(lines.line_dedup(df, min_words=words), "n_lines", "n_removed", "text") == unlined(rows, 3, words)
    assert lines.line_dedup(df).columns == ["doc_id", "text", "n_words", "gone", "n_lines", "n_removed"]


def test_lines_of_any_column_names_and_repeated_rows(spark):
    rows = [(None, "a\nb\nc", 1), (None, "a\nb\nc", 2), (1, "a\nb\nc", 3), (1, "a\nb\nc", 4), (2, "x\na\nb\nc", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d long").withColumns({c: F.lit(7) for c in ("t", "gone", "__d", "__t", "__gone", "hash", "first")})
    out = lines.line_dedup(df).orderBy("d").collect()
    assert [(r["d"], r["n_removed"], r["text"]) for r in out] == [(1, 0, "a\nb\nc"), (2, 0, "a\nb\nc"), (3, 3, ""), (4, 3, ""), (5, 3, "x")]
    assert all(r["t"] == r["__d"] == r["gone"] == 7 for r in out)


def test_only_repeated_fingerprints_are_joined(spark):
    """Of texts that share one passage in a thousand lines, hardly any position goes on, and far fewer positions than windows do."""
    rows = [(i, 0, "\n".join(f"{i} {k}" if k < 90 else f"shared {k}" for k in range(100))) for i in range(10)]
    found = spark.createDataFrame(rows, "d long, t long, text string").mapInArrow(lines._positions(3, None), "d long, t long, fingerprint long, windows array<struct<start:int,stop:int,hash:long>>")
    n_windows = found.select(F.sum(F.size("windows"))).first()[0]
    assert n_windows == 980 and found.count() < 0.7 * n_windows and lines.repeated(found).count() <= 100


# -- packing


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4") for i, text, *_ in rows}
    out = packing.pack(docs, path, length=64, with_ids=True).collect()
    filled = {}
    for p in sorted(out, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"] and own.tolist() == p["ids"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in out) == sum(map(len, ids.values()))
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    assert sorted(filled) == list(range(len(filled)))


@pytest.mark.parametrize("histogram, least", [
    ({100: 1000}, 0.97), ({4096: 500, 100: 5000}, 0.97), ({200: 10_000, 50: 10_000}, 0.97), ({n: 30 for n in range(50, 1001)}, 0.98), ({1: 5000}, 0.6), ({4096: 3}, 1.0), ({2049: 10, 2047: 10}, 1.0), ({1366: 300, 1365: 1}, 0.66), ({}, 0.0),
])
def test_packing_pads_little(histogram, least):
    found = packing.patterns(histogram, 4096)
    placed = {}
    for lengths, count in found:
        assert sum(lengths) <= 4096 and count > 0
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram and len(found) <= 3 * len(histogram)
    tokens = sum(n * c for n, c in histogram.items())
    assert tokens >= least * 4096 * sum(c for _, c in found)


def test_tokens_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(2)
    alphabet = "aAéÉ'st!.,- \n\t\x1c\x85́̇IİK<|endoftext|>5½語😀"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(3000)] + ["<|endoftext|> don't it's", "", "hello <|endoftext|> world", "<|startoftext|>", "x" * 300 + " " + "É" * 200]
    got = packing.token_ids(path, pa.array(texts))
    for text, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_tokens_of_capitals_before_marks_that_combine():
    """T and a diaeresis are a letter and a mark, t and a diaeresis one letter: small letters come after composition."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(5)
    alphabet = "aTtJjHÀéÊßÿŸ÷×_'.s \u0308\u030c\u0331\u0301\u1dca5Σς"
    texts = ["T\u0308a", "J\u030c", "H\u0331.", "T", "\u0308", "ÊTÉ.Là'Ÿ", "É\u0301", *["".join(r.choice(alphabet) for _ in range(r.randrange(20))) for _ in range(3000)]]
    for text, g in zip(texts, packing.token_ids(path, pa.array(texts)), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_simple_words_are_not_encoded_as_texts(monkeypatch):
    """An encoding of its own costs several times a word's ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(6)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randrange(3, 12))) for _ in range(2000)]
    text = " ".join(r.choice(["{}", "{},", ".{}", "({})", "{}***"]).format(r.choice([str, str.title])(w)) for w in words)
    packing.token_ids(path, pa.array(["a"]))
    packing._loaded[path].known.clear()
    asked, ids = [], packing._Encoder.ids
    monkeypatch.setattr(packing._Encoder, "ids", lambda self, texts: (asked.extend(texts), ids(self, texts))[1])
    got = packing.token_ids(path, pa.array([text]))
    assert len(asked) < 300, asked[:20]
    assert got == ids(packing._loaded[path], [text.encode()])


def test_tokens_of_other_vocabularies():
    """One that keeps case and spaces is encoded whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), ["Hello  World, it's", "", "a\tB<|endoftext|>", "語"]
    for text, g in zip(texts, packing.token_ids(path, pa.array(texts)), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_a_task_leaves_no_ids_behind(monkeypatch):
    """Python workers outlive their tasks and share an executor's memory with it."""
    import types

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["some words here", None])})
    (out,) = packing._cut(path, 2, 4096, False)(iter([batch]))
    assert out.column("doc_tokens").to_pylist() == [len(packing.token_ids(path, pa.array(["some words here"]))[0]) // 4 + 1, 1]
    packing._loaded[path].known.clear()
    list(packing._cut(path, 2, 4096, False)(iter([batch])))
    assert not packing._loaded[path].known


def test_kept_powers_are_bounded():
    """A megabyte of text needs powers up to the length of a step, and its words far fewer."""
    from millrace.llm import common

    known = common._powers.__defaults__[0]
    known.clear()
    text = pa.array([("word " * (common.CHUNK // 5 + 1))[: common.CHUNK]])
    words = common.Words(*common.text_bytes(text))
    hashes = words.hashes()
    assert len(np.unique(hashes)) <= 2 and len(np.unique(common.runs(hashes, 5))) <= 2
    assert len(known[common._BASE][0]) <= common.CHUNK + 1 and len(known[common._STEP][0]) <= common.CHUNK // 4 + 1


def test_patterns_hold_the_histogram():
    r = random.Random(4)
    histogram = {n: r.randrange(1, 50) for n in r.sample(range(1, 513), 200)}
    found = packing.patterns(histogram, 512)
    used = {}
    for own, count in found:
        assert sum(own) <= 512 and own == sorted(own, reverse=True) and count > 0
        for n in own:
            used[n] = used.get(n, 0) + count
    assert used == histogram


# -- sentence pieces


def test_sentencepieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    t, library = sentencepieces.Transducer.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    alphabet = "ab é▁ \n\t<s>/語😀the inginging aaaa  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(3000)] + [x[1] or "" for x in corpus(20)]
    for x in texts:
        ids = np.frombuffer(t.encode(x), "<i4").tolist()
        assert ids == library.encode(x), x
        assert t.decode(t.encode(x)) == x.replace("▁", " ")
        assert np.frombuffer(t.compose(t.normalise(x[:200])), "<i4").tolist() == library.encode(x[:200])


def test_merging_path_leaves_places_beside_it():
    """Where the longest arc is right, nothing is looked up from places within it; where it's wrong, the search comes back."""
    import public_tokenizers
    import sentencepiece

    class Counted(list):
        looked = 0

        def __getitem__(self, k):
            Counted.looked += 1
            return super().__getitem__(k)

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        t = sentencepieces.Transducer(f.read())
    t.next = Counted(t.next)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "international understanding of unbelievable circumstances requires considerable transportation responsibilities notwithstanding"
    assert np.frombuffer(t.encode(text), "<i4").tolist() == library.encode(text)
    assert Counted.looked < 2 * len(text), Counted.looked
    t.next = list(t.next)
    r = random.Random(4)
    for _ in range(500):  # no longest piece is sure to be right in these
        x = "".join(r.choice("enrstai") for _ in range(r.randrange(40)))
        assert np.frombuffer(t.encode(x), "<i4").tolist() == library.encode(x), x
    assert t.encode("") == b"" and t.follow("") == b""


def test_sentencepieces_of_tables(docs, none, rows):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepieces.decode(sentencepieces.encode(docs, path), path)
    assert by_id(back, "text") == [(i, text or "") for i, text, *_ in sorted(rows)]
    assert all(r["same"] for r in sentencepieces.round_trip(docs, path).collect())
    assert sentencepieces.round_trip(none, path).count() == 0


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser(prefix, squeeze):
    n, r = sentencepieces.Normaliser(prefix, squeeze), random.Random(5)
    for text in ["", " ", "a", " a", "a ", *("".join(r.choice("ab  \n") for _ in range(r.randrange(12))) for _ in range(300))]:
        plain = re.sub(" +", " ", text).strip(" ") if squeeze else text
        assert n(text) == ((" " if prefix and plain else "") + plain).replace(" ", sentencepieces.MARK), text


def test_unigram_paths_are_shortest():
    """A unigram model by hand: the path of least sum among all segmentations."""
    t = object.__new__(sentencepieces.Transducer)
    t.byte, t.unknown, t.merging = {}, 9, False
    t.compile({"a": (0, -1.0), "b": (1, -1.5), "ab": (2, -2.0), "aba": (3, -4.1)})

    def best(text):
        if not text:
            return 0.0
        return min(best(text[len(p) :]) - t.score[i] for p, i in t.ids.items() if text.startswith(p))

    for text in ("ab", "aba", "abab", "aabba", "bbaabab"):
        ids = np.frombuffer(t.compose(text), "<i4").tolist()
        assert "".join(t.text[i] for i in ids) == text and abs(sum(-t.score[i] for i in ids) - best(text)) < 1e-9


# -- WARC


def test_warc(spark):
    big, other = "x" * 1500 + "é", "y" * 1000
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other), (7, "u", other), (8, "u", other), (None, "u", big), (None, "u", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    out = warc.archived(df, with_payload=True).collect()
    assert len(out) == len(rows)
    for r in out:
        own = next(h or "" for i, _, h in rows if i == r["page_id"] and (i is not None or len(h) == r["payload_bytes"] - (h == big)))
        assert r["payload_digest"] == hashlib.sha1(own.encode()).hexdigest() and r["payload_bytes"] == len(own.encode())
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    kinds = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    assert kinds == sorted([("1", 1502, "revisit", 3), ("2", 1502, "revisit", 3), ("3", 1502, "response", None), ("4", 5, "response", None), ("5", 5, "response", None), ("6", 0, "response", None), ("7", 1000, "revisit", 8), ("7", 1000, "revisit", 8), ("8", 1000, "response", None), ("None", 1502, "response" if False else "revisit", 3), ("None", 2000, "response", None)])
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    import io

    data = warc.record("response", "u", "urn:page:1", b"payload", warc.sha1(b"payload"))
    assert [r.payload for r in warc.read_records(io.BytesIO(data * 3), step=7)] == [b"payload"] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.record("response", "u", "i", b"payload", warc.sha1(b"other")))))


# -- quality


def test_quality(spark, none):
    r = random.Random(6)
    good, bad, rude = [f"g{i}" for i in range(80)], [f"B{i}!!" for i in range(80)], ["scum", "idiot"]
    rows, told = [], []
    for i in range(400):
        kind = r.choice("ggbt")
        words = [r.choice(bad if kind == "b" else good) for _ in range(60)]
        if kind == "t":
            words[5], words[20] = rude
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        if i % 2:
            told.append((i, int(kind != "b"), int(kind == "t")))
    rows += [(400, None, None, None), (401, "", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("p_meta", F.lit("clash"))
    labels = spark.createDataFrame([*told, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in cotrain.score_quality(df, labels).collect()}
    held = [i for i in range(0, 400, 2)]
    right = [out[i]["keep"] == (rows[i][1].startswith("g") and "scum" not in rows[i][1]) for i in held]
    assert sum(right) / len(right) > 0.95 and len(out) == 402
    untold = cotrain.score_quality(df, labels.limit(0)).collect()
    assert all(x["keep"] and x["p_quality"] is None for x in untold)
    assert cotrain.score_quality(df.limit(0), labels).count() == 0


def test_text_model_is_fitted_by_stretches(monkeypatch):
    """What the driver holds for each entry while it fits is its place alone; all else is of one stretch. The weights don't depend on where stretches end."""
    r = np.random.default_rng(9)
    y = (r.random(3_000) < 0.7).astype(float)
    rows = [np.unique(r.integers(0, 20_000, 800) + 3_000 * int(label)).astype(np.int32) for label in y]
    trust = np.where(r.random(3_000) < 0.3, 0.25, 1.0)
    tracemalloc.start()
    model = cotrain.TextModel.fit(rows, y, trust, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(map(len, rows)), peak
    few = [rows[0][:0], *rows[:40], rows[0][:0]]
    told, sure = np.concatenate([[1.0], y[:40], [0.0]]), np.ones(42)
    whole = cotrain.TextModel.fit(few, told, sure)
    monkeypatch.setattr(cotrain._stretches, "__defaults__", (1_000,))
    assert np.allclose(cotrain.TextModel.fit(few, told, sure).weights, whole.weights, atol=1e-9)
    assert np.allclose(whole.of(few), [whole.weights[x].sum() + whole.weights[-1] for x in few])
    assert len(model.of(rows)) == 3_000


def test_quality_of_held_out_labels(spark):
    """Trained on half of the labels; the other half tells how good it is. Repeated rows are no further labels."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = docs.where("doc_id % 2 = 1").limit(1)
    docs = docs.unionByName(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("copy"))
    kept = {r["doc_id"]: r["keep"] for r in cotrain.score_quality(docs, labels.where("doc_id % 2 = 1")).select("doc_id", "keep").collect()}
    told = labels.where("doc_id % 2 = 0").collect()
    good = [kept[r["doc_id"]] for r in told if r["quality"] == 1 and r["toxic"] == 0]
    bad = [kept[r["doc_id"]] for r in told if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_confident_ones_are_the_surest_of_all(spark):
    r = random.Random(7)
    rows = [(k, r.gauss(0, 4), r.gauss(0, 4)) for k in range(500)]
    got = cotrain.confident(spark.createDataFrame(rows, "key long, a double, b double"), 0.75, 40, 0.9, [{1, 2}, {3}])
    for taker, giver, taken in ((0, 2, {1, 2}), (1, 1, {3})):
        left = sorted((x for x in rows if x[0] not in taken), key=lambda x: -x[giver])
        assert got[taker] == {x[0]: 1 for x in left[:30]} | {x[0]: 0 for x in left[:-11:-1]}


# -- licenses


def as_pattern(template):
    """The template as a regular expression over words that are joined by spaces."""
    out = ""
    for part in re.findall(r"<</?optional>>|<<any \d+>>|[^\s<>]+", template):
        out += {"<<optional>>": "(?:", "<</optional>>": ")?"}.get(part) or (f"(?: [^ ]+){{0,{part[6:-2]}}}" if part[0] == "<" else " " + re.escape(part))
    return re.compile(out + "(?= |$)")


def test_licenses(spark):
    r = random.Random(3)
    whole = {label: re.sub("<<any (\\d+)>>", lambda m: "THE AUTHORS," if int(m[1]) > 1 else "1.", re.sub("<</?optional>>", "", t)) for label, t in licenses.LICENSES.items()}
    texts = [
        None, "", "Released under the MIT License. Under the MIT license", "Apache License, Version 2.0 and CC BY-NC 4.0", "under the mit\n\nlicense é", "mit license under the",
        "This work is licensed under the GNU General Public License, version 3.", whole["mit"].upper(), whole["bsd-2"], whole["bsd-3"], whole["isc"], whole["zlib"], whole["mit"].replace("substantial", "some"), whole["bsd-3"].replace("neither the name", "the name"),
    ]
    for _ in range(40):
        w = [x for label in r.sample(sorted(whole), 2) for x in [*whole[label].split(), "and", "then"]]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "other"
        texts.append(r.choice(["\n", " ", ", "]).join(w))
    df = spark.createDataFrame([(i, t) for i, t in [*enumerate(texts), (0, None), (9, texts[9])]], "doc_id long, text string").withColumn("labels", F.lit(1))
    out = licenses.license_scan(df).orderBy("doc_id").collect()
    assert len(out) == len(texts) + 2 and out[0]["doc_id"] == out[1]["doc_id"]
    rows = {x["doc_id"]: x for x in out}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = [(label, as_pattern(t)) for label, many in licenses.TEMPLATES.items() for t in many]
    for i, text in enumerate(texts):
        x, w = rows[i], word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (x["n_words"], x["n_base"], x["base_labels"]) == (len(w), len(places), ",".join(sorted({y for _, y in places})))
        assert (x["first_word"], x["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        accepted = {label for label, p in patterns if p.search("".join(" " + y for y in w))}
        assert x["labels"] == ",".join(sorted(accepted | {y for _, y in places})), text
        assert 0 <= x["score"] <= 1 and (x["score"] > 0) == bool(accepted)
    assert [rows[i]["labels"] for i in range(5, 14)] == ["", "gpl-3", "mit", "bsd-2", "bsd-3", "isc", "zlib", "", ""]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_automata():
    a = licenses.Automaton.compile("<<optional>>all <<any 2>><</optional>> rights <<optional>>are<</optional>> reserved <<any 1>> now")
    accepts = lambda s: (hit := a.accept(w := licenses.words_of(s.encode()), 0)) is not None and hit[0] == len(w)
    assert all(map(accepts, ["rights reserved now", "all rights reserved now", "all my own rights are reserved here now", "rights are reserved x now"]))
    assert not any(map(accepts, ["rights reserved", "all a b c rights reserved now", "rights reserved a b now", "right reserved now"]))
    for bad in ("<<optional>> a", "<<any 3>>"):
        with pytest.raises(ValueError):
            licenses.Automaton.compile(bad)


# -- audio


def test_audio(docs, rows, none):
    kept = audio.audio_features(audio.store_media(docs))
    out = audio.with_digests(kept).orderBy("doc_id").collect()
    parts = {}
    for r in sorted(audio.stored_tensors(kept).collect(), key=lambda r: (r["doc_id"], r["nth"])):
        parts.setdefault(r["doc_id"], []).append(r)
    for r, (i, text, *_) in zip(out, sorted(rows), strict=True):
        raw = (text or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (size - len(raw))
        media = audio.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        own = parts[i]
        assert len(own) == r["n_tensors"] == r["n_spans"] == -(-r["frames"] // 64) and all(len(t["mel"]) == 64 * 40 for t in own)
        assert own[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(own, own[1:], strict=False)) and abs(own[-1]["stop"] - r["frames"] * 0.01) < 1e-9
        assert zlib.crc32(np.array([t["mel"] for t in own], "<i2").tobytes()) == r["mel_crc32"]
    same = {}
    for r in out:
        same.setdefault(r["payload_sha256"], set()).add((r["mel_crc32"], str(r["segments"])))
    assert all(len(x) == 1 for x in same.values()) and len(same) < len(out)
    assert audio.with_digests(audio.audio_features(audio.store_media(none))).count() == 0


def test_tensors_are_stored_as_such(docs):
    import pyarrow.parquet as pq

    path = audio.audio_features(audio.store_media(docs)).first()["path"]
    kind = pq.read_schema(path.removeprefix("file://")).field("mel").type
    assert kind == audio.TENSOR and kind.shape == [64, 40]


def test_log_mel_against_the_sums():
    """Windows, discrete Fourier sums and triangles written out."""
    x = np.sin(np.arange(1000) * 0.3) + np.sin(np.arange(1000) * 1.1)
    mel, energy = audio.log_mel(x, 8000)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top, low = (2595 * np.log10(1 + f / 700) for f in (4000, 20))
    edge = [hz(low + (top - low) * k / 41) for k in range(42)]
    assert len(mel) == (1000 - 200) // 80 + 1
    for frame in (0, 7):
        part = [x[80 * frame + n] * (0.5 - 0.5 * np.cos(2 * np.pi * n / 199)) for n in range(200)]
        power = [abs(sum(part[n] * np.exp(-2j * np.pi * k * n / 256) for n in range(200))) ** 2 for k in range(129)]
        for band in (0, 10, 39):
            weight = lambda f: max(0.0, min((f - edge[band]) / (edge[band + 1] - edge[band]), (edge[band + 2] - f) / (edge[band + 2] - edge[band + 1])))  # noqa: B023, E731
            assert abs(mel[frame, band] - np.log(sum(weight(k * 8000 / 256) * p for k, p in enumerate(power)) + 1e-6)) < 1e-6
        assert abs(energy[frame] - 10 * np.log10(sum(v * v for v in part) / 200 + 1e-10)) < 1e-6
    assert (audio.tensors(mel)[0, : len(mel)] == np.round(mel * 64)).all()


def test_resampling_keeps_low_and_drops_high():
    t = np.arange(4000) / 16000
    low, high = np.sin(2 * np.pi * 500 * t).astype(np.float32), np.sin(2 * np.pi * 7000 * t).astype(np.float32)
    assert np.abs(audio.resample(low)[100:-100] - np.sin(2 * np.pi * 500 * np.arange(2000) / 8000)[100:-100]).max() < 0.02
    assert np.abs(audio.resample(high)[100:-100]).max() < 0.02
    up = audio.resample(low, 3, 2)
    assert len(up) == 6000 and np.abs(up[200:-200] - np.sin(2 * np.pi * 500 * np.arange(6000) / 24000)[200:-200]).max() < 0.02


def test_segments_have_hysteresis():
    energy = np.array([0, 0, 5, 10, 6, 5, 1, 0, 10, 10, 5, 0], float)
    on, expected, lo, hi = False, [], *np.percentile(energy, [40, 60])
    for e in energy:
        on = e >= hi or (on and e >= lo)
        expected.append(on)
    got = np.zeros(len(energy), bool)
    for a, b in audio.segments(energy):
        got[a:b] = True
    assert got.tolist() == expected


# -- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 16))
    x[:3000] = x[0]  # one vector that half of all rows have
    rows = [(i, [float(v) for v in q]) for i, q in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 15), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    found = {}
    for h in sorted(out, key=lambda h: (h["query_id"], h["rank"])):
        found.setdefault(h["query_id"], []).append(h["vec_id"])
        assert abs(h["score"] - x[h["vec_id"]] @ x[h["query_id"]]) < 1e-9
    recall = []
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(6000), -s))[:20]
        assert len(found[q]) == 20
        recall.append(len(set(best) & set(found[q])) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.75
    assert found[50] == [i for i in range(22) if i != 50][:20]  # ties go to the smaller id
    assert ann.nearest(df.limit(0), df).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(h["query_id"], h["rank"], h["vec_id"], h["score"]) for h in ann.nearest(few, few.where("vec_id = 20")).orderBy("rank").collect()] == [(20, 1, 2, 0.5), (20, 2, 1, 0.0)]


def test_neighbours_of_repeated_ids(spark):
    """Every row given twice, some ids with a second vector: each id once, with the nearest of its vectors, and no fewer than k."""
    r = np.random.default_rng(5)
    x = r.standard_normal((50, 4))
    rows = [(i, [float(v) for v in q]) for i, q in enumerate(x)] * 2 + [(i, [float(v) for v in -x[i]]) for i in (7, 8, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    for q in (0, 20, 40):
        score = x @ x[q]
        score[7:10] = np.maximum(score[7:10], -score[7:10])
        score[q] = -np.inf
        best = np.lexsort((np.arange(50), -score))[:20]
        own = sorted((h["rank"], h["vec_id"], h["score"]) for h in out if h["query_id"] == q)
        assert [n for n, _, _ in own] == list(range(1, 21)) and len({i for _, i, _ in own} & set(best)) >= 19


def test_chi_square():
    assert abs(ann.chi2_quantile(0.95, 10) - 18.307) < 1e-3 and abs(ann.chi2_cdf(9.342, 10) - 0.5) < 1e-3


# -- empty tables


def test_empty(none, tmp_path):
    import public_tokenizers

    assert substrings.substring_dedup(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert lines.line_dedup(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert licenses.license_scan(none).count() == 0
