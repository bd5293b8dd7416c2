"""Small operators against brute force, and the cases every operator must survive."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetfold.llm import boosting, chat, components, decontaminate, dom, extraction, huffman, language, mixing, quality, simhash, tokens, toxicity, warc
from fleetfold.llm.common import words
from fleetfold.llm.files import read_manifest
from fleetfold.session import work_dir

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CONTROL = ["<", "|", "\\", ">", "lf", "\n", "x", "é", chat.START, chat.END, chat.BREAK, "im_start", "im_end"]


# -- chat --------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.lists(st.sampled_from(CONTROL), max_size=5), st.lists(st.sampled_from(CONTROL), max_size=8)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_turns_come_back(turns):
    source = [("".join(r), "".join(t)) for r, t in turns]
    rendered = [chat.render_turn(*turn) for turn in source]
    assert chat.parse("".join(r[0] for r in rendered)) == source
    for (out, begin, end, _), (_, text) in zip(rendered, source):
        assert chat.unescape(out[begin:end]) == text


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a <|b|> c \\ <x>")[3] is False
    assert chat.render_turn("user", chat.END)[3] is True


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", chat.END), (None, None, None, None), (2, 0, "assistant", None), (1, 1, "assistant", chat.END)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, formatted STRING")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    said = "user\nhi\n" + f"assistant\n{chat.END}\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((chat.END * 2).encode()).hexdigest()
    assert (got[1].loss_chars, got[2].loss_chars) == (2 * len(chat.END), 0)
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


# -- quality -----------------------------------------------------------------------------------


def brute_counts(text):
    gaps = " \t\n\x0b\x0c\r"
    clean = text or ""
    for g in gaps:
        clean = clean.replace(g, " ")
    own = [w for w in clean.split(" ") if w]
    seen = Counter(zip(own, own[1:], own[2:]))
    covered = {i + k for i, g in enumerate(zip(own, own[1:], own[2:])) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(gaps)]
    return len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "  x\x0by\x0cz\r\nw ", "é | <b> é\né | <b> é", "\xa0   a"]
    for size in (5, 30, 300, 3000):
        for alphabet in ("ab", "abcdefgh", "".join(map(chr, range(97, 123)))):
            texts.append("".join(rng.choice(alphabet) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(size)))
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id INT, text STRING, n_words STRING")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_counts(docs).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_lines_are_judged_first(spark):
    good = " ".join(f"Words{i} of a{i} plain sentence{i} that goes{i} on for{i} a while{i} and ends{i} as it{i} should{i}." for i in range(5))
    cases = {
        1: good,
        2: good + "\nHome | About | News | Contact\nCopyright Somebody, all rights reserved.",
        3: "Home | About | News | Contact | Login\n" * 30,
        4: "short. text.",
        5: None,
        6: good.replace("plain", "$$$ plain").replace("on", "%%% on").replace("it", "*** it"),
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id INT, text STRING")
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert got[2].clean_text == good and got[2].n_removed_lines == 2
    assert got[4].base_failed and got[5].base_failed and not got[6].base_failed
    assert quality.clean(docs.limit(0)).count() == 0


def test_words(spark):
    texts = [None, "", " ", "a", " a  b\tc\n", "a b", "a\xa0b c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(words(F.col("t"))).collect()]
    assert got == [[], [], [], ["a"], ["a", "b", "c"], ["a", "b"], ["a\xa0b", "c"]]


# -- simhash -----------------------------------------------------------------------------------


@pytest.mark.parametrize("field", [2, 3])
def test_masks_cover_every_small_difference(field):
    for positions in (list(range(64)), list(range(40, 48)), [1, 5]):
        tables = simhash.masks(positions, 3, field)
        for differing in itertools.combinations(positions, min(3, len(positions))):
            flipped = sum(1 << b for b in differing)
            assert any(mask & flipped == 0 for mask in tables)


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("bucket", [4096, 256])
def test_links_connect_what_pairs_connect(spark, bucket):
    """With the smaller limit the large cluster's buckets have to be split."""
    rng = random.Random(bucket)
    large = rng.getrandbits(64)
    prints = {large ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(900)}
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(rng.randint(1, 12))}
    prints = [simhash._signed(p) for p in sorted(prints)]
    fps = spark.createDataFrame([(p,) for p in prints], "fp LONG")
    roots = {r.node: r.root for r in components.components(simhash.links(fps, bucket=bucket)).collect()}
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(roots.get(p, p), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == brute_components([p & (1 << 64) - 1 for p in prints])


def brute_print(text):
    import xxhash

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = (text or "").translate(table)
    for g in "\t\n\x0b\x0c\r":
        own = own.replace(g, " ")
    own = [w for w in own.split(" ") if w]
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["Ab", "cD", "éÉ", "x"]) + str(rng.randrange(50)) for _ in range(400))
    texts = [None, "", " ", "One", "one two", base, base, base.replace("x1 ", "x2 ", 1), "ÄB c d", "q " * 5000]
    docs = spark.createDataFrame([(i + 10, t, "z") for i, t in enumerate(texts)], "doc_id INT, text STRING, fp STRING")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i + 10].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    want = {i: min(g) + 10 for g in brute_components(prints) for i in g}
    assert {i: got[i + 10].component_id for i in range(len(texts))} == want
    nulls = spark.createDataFrame([(None, "same text here"), (3, "same text here"), (3, "same text here"), (None, "alone in this")], "doc_id LONG, text STRING")
    rows = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(nulls).collect())
    assert rows == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(nulls.limit(0)).count() == 0
    kept = simhash.representatives(docs.withColumn("a", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp", "a"] and {r.doc_id for r in kept.collect()} == set(want.values())


# -- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Reshare until nobody is above the cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 100000]) * rng.randint(1, 9) for s in ["b", "a", "é", "z", "B", None, "c", "d"]}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source STRING, source_size LONG")).collect()
    want = brute_targets(sizes)
    assert all(r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6) for r in rows) and len(rows) == len(want)


def test_mix_takes_its_words(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 200), rng.choice(["a", "b", "c", None]), "x") for i in range(3000)]
    rows += [(None, None, "a", "x"), (5, "dup", "b", "x"), (5, "dup", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, copies STRING")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in got)
    for source in ["a", "b", "c", None]:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


# -- archives and tokens -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "u1", big), (2, None, big), (9, "u9\r\nx", big), (3, "u3", "small"), (4, "u4", "small"), (None, "n", None), (None, "n", big), (9, "u9", big), (5, "", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id LONG, url STRING, html STRING, shard STRING")
    folder = work_dir(spark, "warc")
    manifest = warc.write_warc(pages, folder, file_bytes=1200, shard_rows=3)
    assert manifest.count() > 2
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(manifest, folder).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        old = len(data) >= 1000 and i != 9
        want.append((i if i is not None else -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", 9 if old else None))
    assert got == sorted(want, key=str)
    again = work_dir(spark, "warc")
    warc.write_warc(pages.repartition(5), again, file_bytes=1200, shard_rows=3)
    names = lambda where: sorted((r.file, r.sha256) for r in read_manifest(spark, where).collect())
    assert names(folder) == names(again)
    empty = work_dir(spark, "warc")
    assert warc.read_warc(warc.write_warc(pages.limit(0), empty), empty).count() == 0


@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(runs, spread):
    rng = np.random.default_rng(sum(runs))
    ids = np.minimum(rng.pareto(spread / 3, sum(runs)) * 3, 5000).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1))
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1 and lengths.max(initial=0) <= huffman.LIMIT
    counts = np.array(runs)
    data, begin, marks = huffman.pack(ids, counts, lengths, huffman.codes(lengths))
    segments = -(-counts // huffman.STEP)
    sizes = np.concatenate([np.diff(np.append(np.arange(0, n, huffman.STEP), n)) for n in runs] + [[]]).astype(np.int64)
    out = huffman.unpack(data, marks + np.repeat(begin[:-1] * 8, segments), sizes, *huffman.table(lengths))
    assert (out == ids).all()


def test_huffman_is_optimal():
    counts = np.array([45, 13, 12, 16, 9, 5, 0])
    assert (huffman.code_lengths(counts) * counts).sum() == 224
    assert huffman.code_lengths(2 ** np.arange(10), limit=5).max() == 5


def test_token_files_round_trip(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", " ", "Hello, World! it's we'll", "ÀÉ naïve straße İstanbul ΑΣ", "x\x1cy\x85z\xa0w v", "a<|endoftext|>b <|startoftext|>", "word " * 3000,
             "don't ... ### 12,5 x² ½-cup é ́e 日本語 😀!?", "end."]
    rows = [(i * 3 % 10, t, "z") for i, t in enumerate(texts)] + [(None, "null id", "z"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, shard STRING")
    folder = work_dir(spark, "tokens")
    manifest = tokens.write_tokens(docs, folder, path, file_bytes=300, shard_rows=4, block_ids=50)
    got = sorted(tokens.read_tokens(spark, manifest, folder).collect(), key=lambda r: r.start)
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _, _ in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    empty = work_dir(spark, "tokens")
    assert tokens.read_tokens(spark, tokens.write_tokens(docs.limit(0), empty, path), empty).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_encoder_is_the_tokenizer(text):
    import public_tokenizers

    own = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids


# -- decontamination ---------------------------------------------------------------------------


def brute_tiles(item, doc, match):
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (match - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < match:
            return tiles
        a[i : i + k] = b[j : j + k] = [True] * k
        tiles.append(k)


@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(0, 4), max_size=40))
@settings(max_examples=150, deadline=None)
def test_tiling_is_greedy(item, doc):
    got = [t[2] for t in decontaminate.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)]
    assert sorted(got) == sorted(brute_tiles(item, [x or -1 for x in doc], 3))


def test_contaminated_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    filler = lambda n: [word() for _ in range(n)]
    half = len(item) // 2
    docs = {
        1: filler(300) + item + filler(20),
        2: filler(30) + item[half:] + filler(30) + item[:half],
        3: filler(400),
        4: filler(10) + item[:25] + filler(10),
        5: [w.upper() + "!!" for w in item],
        6: [x for pair in zip(item, filler(40)) for x in pair],
        7: filler(5) + item[:35],
    }
    rows = [(i, " ".join(w), "z") for i, w in docs.items()] + [(8, None, "z"), (9, "", "z"), (1, " ".join(docs[1]), "z"), (None, " ".join(item), "z")]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING, coverage STRING")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(filler(30)))], "item_id LONG, text STRING")
    found = decontaminate.contaminated(table, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("1", 1), ("2", 1), ("5", 1), ("7", 1), ("None", 1)]
    assert {r.doc_id: r.n_tiles for r in found}[2] == 2
    kept = decontaminate.decontaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8, 9]
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0 and decontaminate.contaminated(table, bench.limit(0)).count() == 0


def test_seed_bound_loses_no_pair(spark):
    rng = random.Random(9)
    item = [rng.choice("abc") + str(rng.randrange(6)) for _ in range(30)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(26)
            own += item[at : at + rng.randint(3, 30)] + [f"zz{rng.randrange(99)}"]
        docs.append((i, " ".join(own)))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id LONG, text STRING")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id LONG, text STRING"), bench).collect()}
    want = {i for i, t in docs if sum(brute_tiles(item, t.split(), 5)) >= 0.8 * len(item)}
    assert got == want and 0 < len(want) < 60


# -- models ------------------------------------------------------------------------------------


def test_toxicity_chain(spark):
    rng = random.Random(4)
    clean = ["river", "house", "green", "walks", "never", "paper", "stone", "light", "under", "table"]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(clean) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            own[3], own[9] = "vexatious" + rng.choice(["ly", "ness", "er"]), "grobian"
        poor = i % 7 == 0
        rows.append((i, " ".join(own) + (" ### zap zap" if poor else "")))
        labels.append((i, 0 if poor else 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "vexatiously grobian"), (902, "VEXATIOUSABLE grobian, river"), (903, "river " * 5000)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id LONG, text STRING, toxic STRING")
    table = spark.createDataFrame(labels + [(0, 1, 1), (None, 0, 1), (5000, 1, 1), (1, None, None)], "doc_id LONG, quality INT, toxic INT")
    got = toxicity.classify(docs, table, toxicity.given_categories(), "toxic").collect()
    flags = {r.doc_id: r.toxic for r in got}
    assert len(got) == len(rows) and flags[902] and flags[None] and not flags[903] and not flags[900] and not flags[901]
    assert all(flags[i] == (i % 5 == 0) for i in range(400))
    assert all(0 <= r.p_crude <= 1 for r in got)
    none = toxicity.classify(docs, table.limit(0), toxicity.given_categories(), "toxic")
    assert none.filter("toxic").count() == 0 and none.count() == len(rows)
    assert toxicity.classify(docs.limit(0), table, toxicity.given_categories(), "toxic").count() == 0


def test_out_of_fold_rows_are_unseen():
    import pyarrow as pa

    rows = pa.table({
        "row": range(40), "own_fold": pa.array([i % 4 for i in range(40)], pa.int32()), "y": [[float(i % 2)] for i in range(40)],
        "words": [[f"w{i}", "odd" if i % 2 else "even"] for i in range(40)], "earlier": pa.array([[] for _ in range(40)], pa.list_(pa.float64())),
    })
    out = toxicity._train(0, ["a"])((pa.scalar(1),), rows).to_pydict()
    assert set(out["name"]) == {str(i) for i in range(40) if i % 4 == 1} and set(out["kind"]) == {"probability"}
    assert all((v > 0.5) == (int(n) % 2 == 1) for n, v in zip(out["name"], out["value"]))
    model = toxicity._train(0, ["a"])((pa.scalar(-1),), rows).to_pydict()
    weights = dict(zip(model["name"], model["value"]))
    assert weights["odd"] > 0 > weights["even"]


def test_threshold_lies_in_the_gap():
    p, y = np.array([0.9, 0.6, 0.3, 0.25, 0.02]), np.array([1, 1, 1, 0, 0])
    assert toxicity.choose_threshold(p, y) == pytest.approx(0.275)
    assert toxicity.choose_threshold(p, np.zeros(5)) == toxicity.HIGHEST


def test_languages(spark):
    rng = random.Random(6)
    made = {"xx": ["kata", "moru", "sile"], "yy": ["ßchön", "über", "grüß"], "zz": ["éto", "ñam", "llori"]}
    rows = [(i, " ".join(rng.choice(made[lang]) for _ in range(40)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    extra = [(1000, None, "xx"), (1001, "12 34 !!", "yy"), (1002, "", None), (None, "kata moru", None), (1003, "Kata moru " * 20000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows + extra], "doc_id LONG, text STRING, lang STRING, score STRING")
    got = {r.doc_id: r for r in language.identify(docs, docs.filter("doc_id % 2 = 0")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[1003].lang_pred == got[None].lang_pred == "xx"
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


def test_trees_learn_and_agree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.train(x, y, trees=30, depth=4)
    assert ((boosting.log_odds(model, x) > 0) == (y > 0)).mean() > 0.95


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 9)
        nodes = [dom.Node("div", -1 if i == 0 else rng.randrange(i), 0, []) for i in range(n)]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        kept = extraction.decode(nodes, odds)
        best = 0.0
        for choice in itertools.product([False, True], repeat=n):
            if all(not k or i == 0 or choice[nodes[i].parent] for i, k in enumerate(choice)):
                best = max(best, sum(o for o, k in zip(odds, choice) if k))
        assert all(not k or i == 0 or kept[nodes[i].parent] for i, k in enumerate(kept))
        assert sum(o for o, k in zip(odds, kept) if k) == pytest.approx(best)


def test_dom_reads_what_pages_do():
    page = '<html><head><title>T</title><script>var a="</p>";</script><body><p>a <b>b<p>c &amp; d&am<br>e<ul><li>1<li>2</ul><!-- x --><div class="ad x">z'
    nodes, pieces = dom.read(page)
    assert dom.text_of(pieces, [True] * len(nodes)) == "a b c & d&am e 1 2 z"
    assert [n.tag for n in nodes] == ["document", "html", "body", "p", "p", "ul", "li", "li", "div"] and nodes[-1].tokens == ["ad", "x"]
    assert dom.read("")[1] == [] and dom.read("<")[0] and dom.read("x<script>y")[0]


def test_extraction(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit,", "amet.", "magna"]) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        paragraphs = [line(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        menu = "".join(f'<li><a href="/">{line(1)}</a></li>' for _ in range(6))
        if i % 2:
            page = f'<html><body><nav><ul>{menu}</ul></nav><article><h1>Head</h1>{body}</article><footer>&copy; {line(5)}</footer></body></html>'
        else:
            page = f'<html><body><div class="menu"><ul>{menu}</ul></div><div class="content"><h1>Head</h1>{body}</div><div class="comments"><p>{line(9)}</p></div><div class="sidebar"><ul>{menu}</ul></div></body></html>'
        rows.append((i, f"u{i}", page))
        want[i] = " ".join(["Head", *paragraphs])
    rows += [(500, None, None), (501, "u", ""), (None, "u", "no markup"), (502, "u", "<p>" + "word " * 50000)]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id LONG, url STRING, html STRING, text STRING")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    right = sum(got[i].text == t for i, t in want.items())
    assert right >= 0.95 * len(want) and got[500].text == got[501].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert extraction.extract(pages.limit(0)).count() == 0
