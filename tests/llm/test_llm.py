"""Each operator on odd rows (null, empty, long, tied and repeated ones, clashing columns, empty tables) and against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import chunks, common, decontaminate, langid, lines, packing, pii, quality, records, registry, simhash, tokens, toxicity
from foliant.llm.components import components
from foliant.llm.tagger import Tagger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, length string, fp string, score string, t string"
R = np.random.default_rng(1)
SYLLABLES = "an er ou st ti le re th on in ea nt".split()


def word():
    return "".join(SYLLABLES[i] for i in R.integers(0, len(SYLLABLES), R.integers(1, 5)))


def sentence(n):
    return (" ".join(word() for _ in range(n)) + ".").capitalize()


def prose(lines_=6, n=14):
    return "\n".join(sentence(n) for _ in range(lines_))


ITEM = "Which zebulon quaffed the mirthful grommet beside vortiginous harbour lamps? The answerable quintessence was flibbertigibbet."
BASE = [prose() for _ in range(14)]
TEXTS = [
    *BASE,
    BASE[0],  # copies
    BASE[0],
    BASE[1] + "\n" + sentence(3),  # a near copy
    prose(2) + "\n" + BASE[2].split("\n", 1)[1],  # a repeated run
    BASE[3][:200] + " " + ITEM + " " + BASE[4][:150],  # a leak
    None,
    "",
    " \n\t ",
    "12 34 !!",
    "a",
    prose(900, 20),  # long
    "mail bob.x@site.org or +1 (743) 555-3824, 10.0.0.1 and 4111 1111 1111 1111 " + prose(2),
    "# $ % & " * 80,
    "so much of the same " * 40,
    "Éa Ñu ßtraße 日本 naïve\r\nx\ry",
    *(sentence(6) + "\n" + " ".join(["the", "same", "long"] * 18) + x + sentence(6) for x in ("\n", " \r\n\n")),  # a single long line
]
LONG_LINES = len(TEXTS) - 1


def rows_of():
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", 1, "x", "y", "z", "w", "v") for i, t in enumerate(TEXTS)]
    return [*rows, rows[2], rows[3], (None, BASE[5], "en", "s0", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(7, ITEM), (8, "of it"), (9, None), (7, ITEM), (10, "Another unasked question rests here untouched. Nobody replied grumpily.")], "item_id long, text string")


def pairs():
    return [(r[0], r[1]) for r in rows_of()]


def plain_ids(text):
    return tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens, records, packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcXYZéÉßİıŒñ .,;:!?'\n\t\r 0123<|>_-\u0301日本😀", "\ue000", "<|endoftext|>"]), max_size=30).map("".join), max_size=4))
def test_word_encoder_gives_the_tokenizers_ids(texts):
    encode = tokens.encoder(tokens.default_tokenizer())
    assert encode.by_word
    ids, starts = encode.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [plain_ids(t)[:-1] for t in texts]


def test_word_encoder_without_room_in_its_cache():
    encode = tokens.WordEncoder(tokens.default_tokenizer(), cache_words=3)
    for _ in range(2):
        ids, starts = encode.encode(pa.array(TEXTS[:5]))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [plain_ids(t)[:-1] for t in TEXTS[:5]]
    assert len(encode.words) == 3


def test_records_round_trip(spark, docs, none):
    folder = common.fresh_path(spark, "test")
    manifest = records.write_records(docs, folder)
    got = records.read_records(manifest).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(plain_ids(t))) for d, t in pairs())
    assert [r.doc_id for r in got] == sorted((d for d, _ in pairs()), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc(r.ids))
        start += r.n_tokens
    first = manifest.orderBy("shard").first()
    doc, ids = records.read_record(first.path, first.n_docs - 1)
    assert [(doc, ids.tolist())] == [(r.doc_id, r.ids) for r in got if r.start + r.n_tokens == first.n_tokens]
    assert records.read_records(records.write_records(none, common.fresh_path(spark, "test"))).count() == 0


def test_records_of_a_large_table_have_more_files(spark, docs, monkeypatch):
    table = common.written(docs.select("doc_id", "text"), "test")
    monkeypatch.setattr(records, "FILE_BYTES", 4 << 10)
    manifest = records.write_records(table, common.fresh_path(spark, "test"))
    assert manifest.count() > common.parts_of(spark)
    got = records.read_records(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in pairs()), key=lambda d: (d is not None, d))


def test_records_notice_damage():
    good = records.frame(b"abcdef")
    assert bytes(records.unframe(memoryview(good), 0)[0]) == b"abcdef"
    for i in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(memoryview(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]), 0)
    with pytest.raises(ValueError):
        records.unframe(memoryview(good[:-1]), 0)


def fewest(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(r for r in rooms if r >= lengths[i])):
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(8, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_an_optimum_and_the_plan_holds(case):
    capacity, lengths = case
    plan = packing.Plan(capacity)
    left = packing.reduce_instance(dict(Counter(lengths)), capacity, plan)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert plan.sequences + fewest(rest, capacity) == fewest(lengths, capacity)
    whole, used, got = packing.make_plan(dict(Counter(lengths)), capacity), {}, Counter()
    for length, rank, n, first, wide, offset in whole.arrays().tolist():
        for j in range(n):
            used.setdefault(first + j % wide, []).append((offset + j // wide * length, length))
            got[length] += 1
    assert got == Counter(lengths) and len(used) == whole.sequences
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_places_every_piece(docs, none):
    got = packing.pack_documents(docs, capacity=64, with_ids=True).collect()
    want = Counter()
    for d, t in pairs():
        ids = plain_ids(t)
        for k, a in enumerate(range(0, len(ids), 64)):
            want[d, k, a, tuple(ids[a : a + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    by = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True)) and sum(own[-1]) <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert packing.pack_documents(none).count() == 0


# near copies


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [*TEXTS[:-6], *TEXTS[-5:], "w" * 500 + " x", "a " * 3, "x" * 31, "x" * 32, "y" * 64 + " z"]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [slow_fingerprint(t) for t in texts]


def same_groups(spark, fps):
    """The forest's groups and those of all pairs."""
    table = common.written(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "test")
    roots = {r.node: r.root for r in components(simhash.links(table)).collect()}
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    label = common.forest(len(fps), u, v)
    groups, want = {}, {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(int(label[i]), set()).add(x)
    return {frozenset(x) for x in groups.values()}, {frozenset(x) for x in want.values()}


def some_fingerprints(n=400):
    base = R.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base[: n // 2].copy()
    for i in range(len(near)):
        for b in R.choice(64, R.integers(1, 7), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    ball = base[0] ^ np.array([1 << a | 1 << b for a, b in combinations(range(30), 2)], np.uint64)
    return np.unique(np.concatenate([base, near, ball]))


@pytest.mark.parametrize("tile, shard, leaf", [(64, 64, 16), (1 << 16, 16, 8)])
def test_forest_finds_all_links(spark, monkeypatch, tile, shard, leaf):
    for name, value in (("TILE", tile), ("SHARD", shard), ("LEAF", leaf)):
        monkeypatch.setattr(simhash, name, value)
    found, want = same_groups(spark, some_fingerprints())
    assert found == want


def test_forest_as_it_is_in_production(spark):
    fps = some_fingerprints(1000)
    assert simhash.Tree(fps & np.uint64((1 << 21) - 1), simhash.LEAF, 1).nodes  # what a task grows
    many = R.integers(0, 1 << 63, 10_000, dtype=np.uint64)
    assert all(t.nodes for t in simhash.Forest(many.view(np.int64), len(many)).trees)
    found, want = same_groups(spark, fps)
    assert found == want


def test_copies_are_bounded_by_the_ball():
    for n in (2_000, 20_000, 100_000):
        fps = R.integers(0, 1 << 63, n, dtype=np.uint64)
        row, _, home = simhash.Forest(fps.view(np.int64), n).search(fps)
        assert home.sum() == 3 * n and len(row) < 3 * n * (1 + 22)


def test_near_pairs_in_a_shard(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    fps = some_fingerprints()
    home = R.random(len(fps)) < 0.4
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    codes = fps & np.uint64((1 << 21) - 1)
    got = {(min(i, j), max(i, j)) for a, b in simhash.near_pairs(fps, home, codes, 1, 4) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(far <= 4)), strict=True) if i < j and (home[i] or home[j]) and np.bitwise_count(codes[i] ^ codes[j]) <= 1}
    assert want <= got and all(far[i, j] <= 4 for i, j in got)


def test_tree_search_is_exact():
    codes = R.integers(0, 1 << 16, 600, dtype=np.uint64)
    for radius in (1, 2):
        tree = simhash.Tree(codes, 20, radius)
        row, leaf, home = tree.search(codes)
        assert sorted(row[home].tolist()) == list(range(600))
        lives = np.empty(600, int)
        lives[row[home]] = leaf[home]
        reached = set(zip(row.tolist(), leaf.tolist(), strict=True))
        for i, j in zip(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius), strict=True):
            assert (int(i), int(lives[j])) in reached or (int(j), int(lives[i])) in reached


def test_near_duplicate_groups(docs, none):
    got = simhash.near_duplicate_groups(docs).collect()
    fps = np.array([slow_fingerprint(t) for _, t in pairs()], np.uint64)
    label = common.forest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    least = {}
    for (d, _), k in zip(pairs(), label.tolist(), strict=True):
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{int(f):016x}", least[k]) for (d, _), f, k in zip(pairs(), fps, label.tolist(), strict=True))
    assert simhash.near_duplicate_groups(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.tolist()))
    assert simhash.keep_one(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (60, 50), (50, 70)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 70: 50} | {200 + i: 200 for i in range(50)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# repeated lines and passages


def slow_lines(rows, run):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    seen, found = {}, {}
    distinct = {(d, t) for d, t in rows}
    for d, t in sorted(distinct, key=lambda r: (*key(r), signed_hash(r[1]))):
        all_lines = (t or "").split("\n")
        plain = [x.strip(" \t\n\v\f\r") for x in all_lines]
        own = [i for i, x in enumerate(plain) if x]
        drop = set()
        for i in own:
            if len(re.findall("[^\x20\x09-\x0d]+", plain[i])) >= lines.LONG:
                drop |= {i} if ("long", plain[i]) in seen else set()
                seen["long", plain[i]] = True
        for k in range(len(own) - run + 1):
            w = tuple(plain[own[k + j]] for j in range(run))
            if w in seen:
                drop |= {own[k + j] for j in range(run)}
            seen[w] = True
        found[d, t] = "\n".join(x for i, x in enumerate(all_lines) if i not in drop) if drop else t
    return found


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("run", [1, 2, 3])
def test_repeated_lines(docs, none, run):
    got = lines.remove_repeated_lines(docs, run)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    want = slow_lines(pairs(), run)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d, want[d, t]) for d, t in pairs())
    assert want[LONG_LINES, TEXTS[LONG_LINES]] != TEXTS[LONG_LINES]
    assert lines.remove_repeated_lines(none, run).count() == 0


def test_selected_lines_are_window_minima():
    for run in (1, 2, 3, 5):
        hashes = [bytes(x) for x in R.integers(0, 6, (40, 1), dtype=np.uint8)]
        want = {}
        for k in range(len(hashes) - run + 1):
            some = hashes[k : k + run]
            want.setdefault(k + some.index(min(some)), []).append((k, run))
        assert lines.selected(hashes, [], run) == want
    many = [xxhash.xxh3_128_digest(str(i).encode()) for i in range(3000)]
    assert len(lines.selected(many, [], 2)) < 0.7 * len(many)


def test_gear_hash_and_chunks():
    data = np.frombuffer("".join(TEXTS[:3]).encode(), np.uint8)
    h = chunks.gear_hashes(data)
    for i in range(16, len(data), 37):
        assert int(h[i]) == sum(int(chunks.GEAR[data[i - j]]) << j for j in range(16)) % (1 << 16)
    text = "é" * 500 + "".join(TEXTS[:2]) + "ß"
    whole = np.frombuffer(text.encode(), np.uint8)
    ends = chunks.chunk_ends(whole, np.array([0, len(whole)]))[0]
    assert ends[-1] == len(whole) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends, strict=False))
    for a, b in zip([0, *ends], ends, strict=False):
        whole[a:b].tobytes().decode()
    shifted = np.frombuffer(("inserted words " + text[500:]).encode(), np.uint8)
    before = {whole[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}
    again = chunks.chunk_ends(shifted, np.array([0, len(shifted)]))[0]
    after = {shifted[a:b].tobytes() for a, b in zip([0, *again], again, strict=False)}
    assert len(before & after) >= 0.7 * len(after)


def test_repeated_passages(spark, docs, none):
    passage = prose(4, 16)
    more = spark.createDataFrame([(100, prose(3) + " " + passage + " " + prose(2)), (101, prose(1) + passage), (102, prose(5)), (103, "é " + prose(2) + passage[3:])], "doc_id long, text string")
    got = chunks.repeated_runs(more, within=False).collect()
    assert {r.doc_id for r in got} == {101, 103} and {r.first_doc_id for r in got} == {100}
    texts = {r.doc_id: r.text for r in more.collect()}
    for r in got:
        assert len(texts[r.doc_id][r.start : r.end].split()) in (r.words, r.words + 1)
        assert texts[r.doc_id][r.start : r.end][100:-100] in texts[100]
    left = {r.doc_id: r.text for r in chunks.remove_repeated_runs(more).collect()}
    assert left[100] == texts[100] and left[102] == texts[102] and len(left[101]) < len(texts[101]) - 150
    every = chunks.repeated_runs(docs).collect()
    assert {14, 15} <= {r.doc_id for r in every} and chunks.remove_repeated_runs(docs).count() == docs.count()
    assert chunks.repeated_runs(none).count() == 0


def slow_chunks(text):
    """Places of the chunks' ends in bytes, a byte at a time."""
    data = text.encode()
    ends, last = [], 0
    for i in range(len(data)):
        h = sum(int(chunks.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) % (1 << 16)
        inside = i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80
        while i + 1 - last > chunks.MOST:
            cut = last + chunks.MOST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if i + 1 - last >= chunks.LEAST and h >> (16 - chunks.TOP_BITS) == 0 and not inside:
            ends.append(i + 1)
            last = i + 1
    return [*ends, len(data)] if last < len(data) else ends


def slow_runs(rows, run_words, within):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, signed_hash(r[1]))
    first, found = {}, Counter()
    for d, t in sorted(set(rows), key=key):
        data, last, run = (t or "").encode(), 0, []
        for i, end in enumerate([*slow_chunks(t or ""), None]):
            seen = None
            if end is not None:
                seen = first.setdefault(data[last:end], (d, t, i))
            if seen is not None and seen != (d, t, i) and (within or seen[0] != d):
                run.append((last, end, seen[0]))
            else:
                words = len([m for m in re.finditer(rb"[^\x20\x09-\x0d]+", data) if run and run[0][0] <= m.start() < run[-1][1]])
                if run and words >= run_words:
                    firsts = [x[2] for x in run]
                    found[d, len(data[: run[0][0]].decode()), len(data[: run[-1][1]].decode()), words, max(dict.fromkeys(firsts), key=firsts.count)] += 1
                run = []
            last = end
    return found


@pytest.mark.parametrize("run_words, within", [(1, True), (1, False), (chunks.RUN_WORDS, True)])
def test_repeated_runs_against_brute_force(spark, run_words, within):
    shared_ = [prose(1, n) for n in (6, 12, 30, 60)]
    rows = [(i, (t if t is None or len(t) < 20_000 else t[:20_000])) for i, t in enumerate(TEXTS)]
    rows += [(200 + i, prose(2) + " " + " ".join(shared_[j] for j in R.integers(0, 4, 3)) + prose(1)) for i in range(12)] + [(None, shared_[3]), rows[2], (3, rows[4][1])]
    got = chunks.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), run_words, within)
    assert Counter((r.doc_id, r.start, r.end, r.words, r.first_doc_id) for r in got.collect()) == slow_runs(rows, run_words, within)


def test_short_passages_are_found():
    """Passages of 51 words, of short and of usual ones, in two documents."""
    r = np.random.default_rng(7)
    for size, most in ((3.5, 0.04), (5.3, 0.02)):
        some = lambda n: " ".join("".join(chr(97 + x) for x in r.integers(0, 26, 1 + r.poisson(size - 1))) for _ in range(n))  # noqa: B023, E731
        missed = 0
        for _ in range(200):
            passage, found = some(51), []
            for text in (some(40) + " " + passage + " " + some(30), some(33) + " " + passage + " " + some(41)):
                data = np.frombuffer(text.encode(), np.uint8)
                ends = chunks.chunk_ends(data, np.array([0, len(data)]))[0]
                found.append([data[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)])
            best = now = 0
            for x in found[1]:
                now = now + len(x.split()) if x in set(found[0]) else 0
                best = max(best, now)
            missed += best < chunks.RUN_WORDS
        assert missed <= 200 * most, missed


# language, toxicity, quality, personal data


def test_language(spark, docs, none):
    rows = [(i, " ".join(("the and of with " if i % 2 else "der und mit nicht ").split()[j] + word() for j in R.integers(0, 4, 30)), "en" if i % 2 else "de") for i in range(240)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([model.predict(t)[0] == lang for _, t, lang in held]) > 0.95
    assert (model.weights == 0).mean() > 0.2  # the L1 penalty
    got = langid.identify(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert langid.identify(none, model).count() == 0
    assert langid.train(none).predict("some text") == ("und", 0.0)


def test_temperature_is_the_best_one():
    z = R.normal(size=(300, 3)) * 5
    y = np.array([R.choice(3, p=p) for p in langid.softmax(z / 2.5)])
    t = langid.fit_temperature(z, y)
    loss = lambda t: -np.log(langid.softmax(z / t)[np.arange(300), y]).mean()
    assert 1.7 < t < 3.5 and loss(t) <= min(loss(t * 1.05), loss(t / 1.05)) + 1e-9


def test_index_finds_the_nearest():
    vectors = []
    for _ in range(700):
        terms = np.sort(R.choice(40, R.integers(1, 6), replace=False))
        w = R.random(len(terms)).round(1) + 0.1
        vectors.append((terms, w / np.sqrt(w @ w)))
    ids = R.permutation(700)
    index = toxicity.Index(vectors, np.zeros(700, int), ids, 40, block=16)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index.visited = 0
    for q in range(60):
        t, w = vectors[q]
        places, scores = index.nearest(t, w, 7)
        cosine = dense @ dense[q]
        want = np.lexsort((ids, -np.round(cosine, 12)))[:7]
        want = want[cosine[want] > 0]
        assert index.ids[places].tolist() == ids[want].tolist() and np.allclose(scores, cosine[want])
    assert index.visited < 60 * index.blocks * 0.8


def test_index_adds_frequent_terms_in_rows(monkeypatch):
    """The same as all cosines, by fewer than half of the additions that the terms' postings would take; queries with terms beyond the index, without any, and with a place left out."""
    odds = 1 / np.arange(1, 3001)
    vectors = []
    for _ in range(600):
        terms = np.unique(R.choice(3000, 120, p=odds / odds.sum()))
        w = R.random(len(terms)) + 0.1
        vectors.append((terms, w / np.sqrt(w @ w)))
    vectors += [vectors[i % 7] for i in range(40)]  # copies: ties go to the smaller doc_id
    ids = R.permutation(len(vectors))
    index = toxicity.Index(vectors, np.zeros(len(vectors), int), ids, 3000)
    dense = np.zeros((len(vectors), 3000))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    frequency, added, real = (dense > 0).sum(0), [], np.bincount
    monkeypatch.setattr(toxicity.np, "bincount", lambda x, *more, **named: added.append(len(x)) or real(x, *more, **named))
    found = [index.nearest(*vectors[q], 15) for q in range(300)]
    assert sum(added) < sum(int(frequency[t].sum()) for t, _ in vectors[:300]) / 2
    places = {i: at for at, i in enumerate(index.order)}
    left_out = [places[q] if q % 2 else -1 for q in range(300)]
    for q, (at, scores) in enumerate(found):
        cosine = dense @ dense[q]
        want = np.lexsort((ids, -np.round(cosine, 12)))[:15]
        assert index.ids[at].tolist() == ids[want].tolist() and np.allclose(scores, cosine[want], atol=1e-12)
    together = list(index.each_nearest(vectors[:300], 15))
    assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(found, together, strict=True))
    for q, (at, _) in enumerate(index.each_nearest(vectors[:300], 15, left_out)):
        cosine = dense @ dense[q]
        cosine[index.order[left_out[q]] if left_out[q] >= 0 else []] = 0
        assert index.ids[at].tolist() == ids[np.lexsort((ids, -np.round(cosine, 12)))[:15]].tolist()
    beyond, none = index.nearest(np.array([5, 3000, 4000]), np.array([0.5, 0.5, 0.5]), 15), index.nearest(np.zeros(0, np.int64), np.zeros(0), 15)
    assert np.allclose(beyond[1], np.sort(dense[:, 5] * 0.5)[::-1][:15]) and not len(none[0])


def test_isotonic():
    x, y = R.random(60).round(1), (R.random(60) < 0.5).astype(float)
    steps, values = toxicity.isotonic(x, y, np.ones(60))
    assert (np.diff(steps) > 0).all() and (np.diff(values) >= 0).all()
    assert abs(np.interp(x, steps, values).sum() - y.sum()) < 1e-9
    steps, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert steps.tolist() == [1, 2, 3, 4] and values.tolist() == [0, 0.5, 0.5, 1]


def test_toxicity(spark, docs, none):
    rows = [(1000 + i, prose(2) + (f" you {['crudwort', 'vilestem' + word()][i % 2]} " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (1000, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(more, labels).collect()
    assert len(got) == more.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    found = {r.doc_id: r for r in got}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i].predicted == x for i, x in held]) > 0.95
    assert all(found[i].evidence for i, x in held if found[i].predicted)
    used = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(set(r.evidence) <= used for r in got)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_compares_texts_without_leaning_words(spark):
    rows = [(i, prose(2), int(i % 40 == 0)) for i in range(200)]
    rows += [(500 + i, prose(2) + " crudwort", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    used = [(i, t) for i, t, x in rows if x and i < 200 and zlib.crc32(str(i).encode()) % 3 != 1]
    copies = [(1000 + i, t) for i, t in used] + [(2000, "zzz1 zzz2 " + used[0][1])]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame([r[:2] for r in rows] + copies, "doc_id long, text string"), labels).collect()}
    for i, _ in used:
        assert got[1000 + i].evidence[0] == i and abs(got[1000 + i].cosines[0] - 1) < 1e-9
    assert got[2000].evidence[0] == used[0][0] and 0.5 < got[2000].cosines[0] < 0.999  # words that no example has count for the length


def test_toxicity_against_brute_force(spark):
    """Scores by all cosines of a dense matrix."""
    some = [word() for _ in range(120)]
    texts = [" ".join(some[i] for i in R.integers(0, 120, R.integers(2, 40))) + (" crudwort" if i % 5 == 0 else "") for i in range(240)] + ["", None, "nothing known herein", "crudwort"]
    labels = {i: int(i % 5 == 0) for i in range(200)}
    used = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({w for i in used for w in texts[i].split()})
    counts = [Counter(re.findall("[a-z]+", (t or "").lower())) for t in texts]
    y = np.array([labels[i] for i in used])
    has = np.array([[w in counts[i] for w in names] for i in used])
    a, c, n1, n0 = has[y == 1].sum(0), has[y == 0].sum(0), y.sum(), (1 - y).sum()
    chi = (a * n0 - c * n1) ** 2 * (n1 + n0) / np.maximum(1e-9, n1 * n0 * (a + c) * (n1 + n0 - a - c))
    lean = {w: np.sqrt(chi[k]) if a[k] * n0 > c[k] * n1 and a[k] + c[k] < n1 + n0 else 0.0 for k, w in enumerate(names)}
    every = sorted({w for x in counts for w in x})
    df = {w: sum(w in x for x in counts) for w in every}

    def vector(x):
        v = np.array([(1 + np.log(x[w])) * (np.log((1 + len(texts)) / (1 + df[w])) + 1e-6) * (1 + lean.get(w, 0)) if w in x else 0.0 for w in every])
        return v / max(1e-12, np.linalg.norm(v))

    own = np.array([vector(counts[i]) for i in used])
    share = np.ones(2)  # every labelled row is an example

    def raw(v, without=None):
        cosine = own @ v
        if without is not None:
            cosine[without] = 0
        best = [k for k in np.lexsort((used, -np.round(cosine, 12)))[: toxicity.K] if cosine[k] > 1e-12]
        return (toxicity.vote(cosine[best], y[best], share[y[best]]) if best else None), [used[k] for k in best]

    votes = [raw(own[k], k)[0] for k in range(len(used))]
    kept = [k for k, v in enumerate(votes) if v is not None]
    steps, values = toxicity.isotonic(np.array([votes[k] for k in kept]), y[kept].astype(float), np.ones(len(kept)))
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), sample=1_000_000).collect()}
    for i, x in enumerate(counts):
        v, evidence = raw(vector(x))
        want = y.mean() if v is None else np.interp(v, steps, values)
        assert abs(got[i].score - want) < 1e-6 and got[i].evidence == evidence, i
    assert got[240].evidence == got[242].evidence == [] and got[243].evidence


def slow_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    own = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


def test_quality_counts(docs, none):
    got = quality.quality_verdicts(docs).collect()
    want = Counter((d, *slow_counts(t)) for d, t in pairs())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality_verdicts(none).count() == 0


def test_quality_runs_no_python(docs, monkeypatch):
    """No plan that the query runs has Python in it: those of all tables that it writes, and its own."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, name)

    monkeypatch.setattr(quality, "written", written)
    plans.append(quality.quality_verdicts(docs.where("length(text) < 20000"))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow|RDDScan|ExistingRDD", x.replace("Scan ExistingRDD", "") if i == 0 else x) for i, x in enumerate(plans))


def test_quality_outliers(spark):
    rows = [(i, prose(5, 16), "en", "a") for i in range(150)] + [(1000 + i, " ".join(w + "###$$$" for w in prose(5, 16).split()), "en", "a") for i in range(6)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(6)) and sum(got[i].kept for i in range(150)) == 150


def test_quality_repeated_lines_alone_are_outliers(spark):
    repeating = lambda share: prose(20, 16) + "\nOk." * round(share / (1 - share) * 20 + 1)
    rows = [(i, prose(20, 16), "en", "a") for i in range(150)] + [(1000 + i, repeating(0.6 + 0.05 * i), "en", "a") for i in range(3)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].base_failed or got[1000 + i].kept for i in range(3)) and all(got[i].kept for i in range(150))
    for floor in quality.FLOOR[3:]:  # up to the fixed limit's half of the words, and half of the lines
        assert np.log(51) ** 2 / floor > quality.CUT


def test_mcd_steps_until_the_determinant_stays(spark):
    x = np.random.default_rng(8).normal(size=(300, 5))
    x[:70] = x[:70] * 0.3 + 3
    table = common.written(spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{v} double" for v in quality.VECTOR)), "test")
    params = quality.mcd_params(table)
    far = quality._with_distance(table, params, ["g"])
    limit = far.agg(F.percentile_approx("d2", quality.H_SHARE, quality.ACCURACY)).first()[0]
    again = quality._moments(far.where(F.col("d2") <= limit), ["g"], quality._SCALE).first()
    assert again.logdet > params.first().logdet - 1e-5


def test_mcd_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(400, 5)) @ np.diag([1, 2, 1.5, 1, 3]) + 5
    x[:60] += 25
    table = common.written(spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{v} double" for v in quality.VECTOR)), "test")
    got = quality.mcd_params(table).first()
    center = np.array([got[f"m{i}"] for i in range(5)])
    assert np.abs(center - x[60:].mean(axis=0)).max() < 0.5
    clean = np.cov(x[60:].T, bias=True) + np.diag(quality.FLOOR)
    low = np.zeros((5, 5))
    for i, j in quality._PAIRS:
        low[i, j] = got[f"l{i}{j}"]
    # the subset has 300 of the 340 clean rows, while the scale is that for 3 of 4
    share = quality.H_SHARE * 400 / 340
    scale = share / quality._chi2_cdf(quality.chi2_quantile(share, 5), 7)
    assert 0.6 < np.linalg.det(low @ low.T) / np.linalg.det(clean) / (quality._SCALE / scale) ** 5 < 1.6


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_quantile(0.999, 7) - 24.3219) < 1e-3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0123()é\n_%", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_cards_and_long_runs():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112; 1.2.3.4.5 300.1.1.1 " + "9" * 50_000 + " " + "a." * 50_000 + "@"
    assert pii.base_spans(text) == slow_base(text[:70]) and pii.luhn("4111111111111111")


def test_tagger_gradients_and_learning():
    ids, tags = pii.training_windows([t for t in TEXTS if t], most=300)
    tagger = Tagger(4)
    _, grad = tagger.step(ids[:6], tags[:6].astype(int))
    for name in ("emb", "xf", "hb", "bf", "out", "trans", "first"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        old, sides = tagger.p[name][at], []
        for step in (0.01, -0.01):
            tagger.p[name][at] = old + step
            sides.append(tagger.step(ids[:6], tags[:6].astype(int))[0])
        tagger.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 0.02 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 0.02


@pytest.fixture(scope="module")
def tagger():
    return pii.train([t for t in TEXTS if t])


def test_tagger_on_windows_it_has_not_seen(tagger):
    ids, tags = pii.training_windows([prose() for _ in range(20)], most=400, seed=99)
    assert (tagger.decode(ids) == tags)[tags > 0].mean() > 0.85


def test_personal_data(docs, none, tagger):
    got = pii.find_personal_data(docs, tagger).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == slow_base(r.text) and all(s in r.spans for s in r.base)
    clean = [r for r in got if r.text and not re.search("[0-9@]", r.text)]
    assert clean and not any(r.spans for r in clean)
    assert pii.find_personal_data(none, tagger).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(pii.find_personal_data(docs, tagger)).collect()}
    mail = next(i for i, t in enumerate(TEXTS) if t and "bob.x" in t)
    assert red[mail].startswith("mail <email> or <phone>, <ip> and <card>") and red[0] == TEXTS[0]


def other_forms(r):
    """Personal data that no pattern finds, made from lists of names and templates that the training knows nothing of: kind and text."""
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    digits = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    first, last, host = pick("maria", "john", "Xavier", "li", "Oksana", "paul", "ines", "Tariq"), pick("gruber", "Smith", "oconnor", "nguyen", "Delacroix", "lund"), pick("acme", "uni-bonn", "post", "northwind", "mailbox", "cityhall", "gardenclub")
    user, end = pick(f"{first}.{last}", f"{first[0]}{last}", f"{first}_{last}", first, f"{first}{digits(2)}", f"{last}-{first}"), pick("com", "de", "org", "fr", "edu", "co")
    card = "5" + digits(14)
    card += next(str(x) for x in range(10) if pii.luhn(card + str(x)))
    return pick(
        ("email", pick(f"{user} [at] {host} [dot] {end}", f"{user}[at]{host}[dot]{end}", f"{user} (at) {host}.{end}", f"{user} at {host} dot {end}", f"{user} @ {host}.{end}", f"{user} (AT) {host} (DOT) {end}")),
        ("ip", pick("[.]", " . ", "[dot]", "(.)").join(str(int(x)) for x in r.integers(1, 255, 4))),
        ("card", ".".join([card[:4], card[4:8], card[8:12], card[12:]])),
        ("phone", pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0049 {digits(3)} {digits(7)}", f"0033-{digits(1)}-{digits(8)}")),
    )


def test_added_spans_on_other_forms(tagger):
    """Recall and precision of added spans, by a generator that has nothing in common with the training's."""
    r = np.random.default_rng(31)
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    hits, added, total, by = 0, 0, 0, Counter()
    for _ in range(400):
        kind, own = other_forms(r)
        head = pick("Reach me at home: ", "contact ", "The record shows ", "(new) ", "sent from ", "Bitte an ") if "at " not in own else pick("contact ", "write to ")
        text = prose(1, 9) + " " + head + own + pick(", thanks. ", ". ", " or later ", "; ") + prose(1, 9)
        base, every = pii.all_spans([text], tagger)[0]
        more = [s for s in every if s not in base]
        total, added = total + 1, added + len(more)
        hit = any(k == kind and text[a:b] == own for k, a, b in every)
        hits += hit
        by[kind, hit] += 1
    clean = 0
    for _ in range(400):
        n = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
        text = prose(1, 9) + " " + pick(f"on 20{n(2)}-0{n(1)}-1{n(1)}", f"for ${n(3)}.{n(2)}", f"ISBN 97{n(1)}-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"version {n(1)}.{n(2)}.{n(1)}", f"sha {R.bytes(16).hex()}", f"at {n(2)}:{n(2)}", f"see [at] the end, dot by dot, {n(4)}", f"@{word()} said", f"pages {n(3)}-{n(3)}") + " " + prose(1, 9)
        base, every = pii.all_spans([text], tagger)[0]
        clean += len(every) > len(base)
    assert hits >= 0.9 * total, by
    assert hits >= 0.95 * added and clean <= 8, (hits, added, clean)


def test_windows_left_out_change_nothing(tagger):
    """Decoding every window of the grid gives the same spans as the windows about triggers."""
    r = np.random.default_rng(5)
    texts = [prose(2) + " " + other_forms(r)[1] + " " + prose(1) + " " + other_forms(r)[1] + ", " + prose(3) for _ in range(40)] + [t for t in TEXTS if t and len(t) < 20_000]
    every = pii.tagged_spans(texts, tagger, lambda t: list(range(0, max(1, len(t)), pii.STRIDE)))
    assert pii.tagged_spans(texts, tagger) == every


# decontamination


def test_longest_common_subsequence():
    for _ in range(200):
        a, b = ([SYLLABLES[i] for i in R.integers(0, 4, R.integers(1, 12))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_words(decontaminate.place_bits(a), len(a), b) == t[-1, -1]


def test_leaks(spark, docs, none, benchmark):
    words = ITEM.split()
    changed = " ".join(w for i, w in enumerate(words) if i not in (3, 7))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500, prose(3) + " " + ITEM.upper() + " " + prose(3)), (501, prose(4) + changed + prose(2)), (502, " ".join(words[:4]) + prose(3))], "doc_id long, text string"))
    got = decontaminate.leaks(more, benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(18, 7), (500, 7), (501, 7)])
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.leaks(none, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def blocks_of(benchmark):
    return decontaminate.Block(benchmark.select("item_id", "text", F.lit(None).cast("string").alias("answer")).collect())


def test_latent_axes_against_a_plain_svd(spark, docs, benchmark):
    block = blocks_of(benchmark)
    table = common.written(decontaminate.term_table(docs.select("doc_id", "text"), block.terms), "test")
    frequency, total = decontaminate.stretch_frequency(table, block.terms)
    cut = [w[a : a + 32] for _, t in pairs() if (w := decontaminate.words_of(t)) for a in range(0, len(w), 32)]
    assert total == len(cut) and frequency == {w: n for w in block.terms if (n := sum(w in x for x in cut))}
    block.weigh(frequency, total)
    axes = decontaminate.latent_axes(table, block, np.arange(len(block.terms)), total)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-4)
    # the items, which count as much as all stretches, lie in the latent space
    assert np.allclose(block.vectors @ axes @ axes.T, block.vectors, atol=1e-3)
    # a small rank: as much of the whole as the best axes hold, nearly
    many = np.zeros((len(cut), len(block.terms)))
    for i, x in enumerate(cut):
        for w in x:
            if w in block.terms:
                many[i, block.terms.index(w)] += block.idf[block.terms.index(w)]
    many /= np.maximum(1e-12, np.linalg.norm(many, axis=1, keepdims=True))
    whole = np.concatenate([many, block.vectors * np.sqrt(total / len(block.ids))])
    assert np.linalg.norm(whole @ axes) ** 2 > 0.98 * (np.linalg.svd(whole)[1][: axes.shape[1]] ** 2).sum()


def sure_leaks(rows, items):
    """Pairs with a window that passes the check, from all windows of all documents and all items, without any search."""
    block = decontaminate.Block(items)
    found = set()
    at = {w: i for i, w in enumerate(block.terms)}
    for d, t in rows:
        words = decontaminate.words_of(t)
        for k, own in enumerate(block.words):
            width = 1 + (1 << max(0, int(np.ceil(np.log2(len(own) / 32)))))
            stretches = -(-len(words) // 32)
            for s in range(max(1, stretches - width + 1)):
                part = words[max(0, s * 32 - len(own)) : (s + width) * 32 + len(own)]
                common_ = decontaminate.common_words(decontaminate.place_bits(own), len(own), part) / len(own)
                answer = decontaminate.common_words(decontaminate.place_bits(block.answers[k]), len(block.answers[k]), part) / max(1, len(block.answers[k]))
                if common_ >= 0.8 or common_ >= 0.6 and answer >= 0.8:
                    found.add((d, block.ids[k]))
    return found


def test_latent_search_against_all_pairs(spark):
    """Recall over all pairs of documents and items of several lengths, whole and with words replaced or left out."""
    r = np.random.default_rng(12)
    question = lambda n: sentence(n - 5) + " " + sentence(5)
    items = [(k, question(n)) for k, n in enumerate([8, 12, 15, 20, 25, 31, 33, 40, 48, 60, 64, 65, 90, 130, 260])]
    rows = [(i, prose(8, 16)) for i in range(60)]
    for k, text in items:
        words = text.split()
        for j in range(6):
            own = [w if i >= len(words) - 5 or r.random() > 0.07 * j else (word() if j % 2 else "") for i, w in enumerate(words)]
            before, after = prose(int(r.integers(1, 5))), prose(int(r.integers(1, 5)))
            rows.append((100 + 10 * k + j, f"{before} {' '.join(own)} {after}"))
    want = sure_leaks(rows, [{"item_id": k, "text": t, "answer": None} for k, t in items])
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 70 and len(got) >= 0.95 * len(want), sorted(want - got)
    assert {(100 + 10 * k, k) for k, _ in items} <= got  # whole items


def test_latent_search_by_groups_of_blocks(spark, monkeypatch, docs):
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    monkeypatch.setattr(decontaminate, "GROUP", 2)
    items = [(k, sentence(20) + " " + sentence(6)) for k in range(30)]
    rows = [(k, prose(3) + " " + t + " " + prose(3)) for k, t in items] + [(100, None)]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, items[3], (3, "other words here")], "item_id long, text string")).collect()
    assert Counter((x.doc_id, x.item_id) for x in got) == Counter((k, k) for k, _ in items)


def test_long_texts_by_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "_STRETCHES", 7)
    monkeypatch.setattr(decontaminate, "_DENSE", 20)
    words = [word() for _ in range(3000)]
    item = " ".join(words[1500:1530])
    block = decontaminate.Block([{"item_id": 1, "text": item, "answer": None}, {"item_id": 2, "text": " ".join(words[100:300]), "answer": None}])
    block.weigh({}, 100)
    axes = np.linalg.qr(np.concatenate([block.vectors.T, np.random.default_rng(0).normal(size=(len(block.terms), 5))], axis=1))[0].astype(np.float32)
    own = [(i, block.terms.index(w)) for i, w in enumerate(words) if w in block.terms]  # in the order of weigh()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "t": pa.array([1]), "n_words": pa.array([3000], pa.int32()), "terms": pa.array([[t for _, t in own]], pa.list_(pa.int32())), "gaps": pa.array([np.diff([i for i, _ in own], prepend=0).tolist()], pa.list_(pa.int32()))})
    part = next(decontaminate.parts([batch], np.arange(len(block.terms))))
    assert part.place.tolist() == [i for i, _ in own] and part.term.tolist() == [t for _, t in own]
    found = {(s, k): c for _, s, k, c in decontaminate.near_passages(part, block, axes, block.vectors @ axes)}
    for width, k in zip(block.window.tolist(), (0, 1), strict=True):
        for s in range(-(-3000 // 32) - width + 1):
            v = np.zeros(len(block.terms))
            for i, t in own:
                if s * 32 <= i < (s + width) * 32:
                    v[t] += block.idf[t]
            cosine = v @ block.vectors[k] / max(1e-9, np.linalg.norm(v))
            assert (cosine >= block.near[k]) == ((s, k) in found) or abs(cosine - block.near[k]) < 1e-3
            assert (s, k) not in found or abs(found[s, k] - cosine) < 1e-3


# queries


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def folder(spark, docs, benchmark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_on_odd_rows(spark, folder, name):
    got = registry.QUERIES[name](spark, folder)
    assert "doc_id" in got.columns
    if name.split("_")[0] in {"op3", "op4", "op5", "op6", "op7", "op8", "op9"}:
        assert got.count() == len(rows_of())
    else:
        got.count()


CLASHING = ["_t", "_id", "_key", "_runs", "_n", "_text", "starts", "gone", "t", "fp", "at", "shard", "role", "lang_pred", "score", "_lang_pred", "_score", "n_lines", "n_removed", "own_id", "_own_id", "_own_key", "key", "number", "base", "spans", "g", "s", "d2", "distance", "kept", "item", "ends", "words", "_w", "_h", "part", "task", "evidence", "length"]


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """A few documents with extra columns by all names that operators use."""
    few = docs.where("text IS NULL OR length(text) < 20000").select("doc_id", "text", "lang", "source", "n_chars")
    return few.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))


def untouched(got, names):
    return all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in got.select("doc_id", *names).collect() for c in names)


def test_extra_columns_stay_as_they_are(spark, clashing, benchmark, tagger):
    n = clashing.count()
    for got, replaced in (
        (lines.remove_repeated_lines(clashing), {"n_lines", "n_removed"}),
        (chunks.remove_repeated_runs(clashing), set()),
        (pii.find_personal_data(clashing, tagger), {"base", "spans"}),
        (langid.identify(clashing, langid.train(clashing)), {"lang_pred", "score"}),
    ):
        assert set(got.columns) == {*clashing.columns, *replaced} and got.count() == n
        assert untouched(got, [c for c in CLASHING if c not in replaced])
    for got in (simhash.keep_one(clashing), decontaminate.without_leaks(clashing, benchmark.withColumn("terms", F.lit("x")))):
        assert got.columns == clashing.columns and 0 < got.count() < n and untouched(got, CLASHING)


def test_extra_columns_are_ignored(spark, clashing, benchmark):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(20)], "doc_id long, toxic int, text string")
    same = lambda run: Counter(map(str, run(clashing).collect())) == Counter(map(str, run(plain).collect()))
    for run in (
        chunks.repeated_runs,
        simhash.near_duplicate_groups,
        quality.quality_verdicts,
        lambda d: decontaminate.leaks(d, benchmark),
        lambda d: toxicity.score_toxicity(d, labels),
        lambda d: packing.pack_documents(d, capacity=64).select("doc_id", "piece", "length", "ids_crc32"),
        lambda d: records.read_records(records.write_records(d, common.fresh_path(spark, "test"))),
    ):
        assert same(run)


def test_stages_keep_clashing_columns(spark, folder, clashing):
    kept = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, kept, folder), "test")
        assert kept.columns == clashing.columns and untouched(kept, CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_empty_tables_in_every_query(spark, none, tmp_path):
    folder = f"file://{tmp_path}"
    none.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file:/")
    table = common.written(spark.range(3), "test")
    assert table.count() == 3
    common.forget(table)
    with pytest.raises(Exception, match="[Pp]ath|exist"):
        spark.read.parquet(table._foliant_path).count()


def test_held_out_flags(spark, folder):
    for r in registry.QUERIES["op4_ftrl_language"](spark, folder).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_personal_data_digest(spark, folder):
    by = {(r.doc_id, r.base_sha256) for r in registry.QUERIES["op7_bilstm_pii"](spark, folder).collect()}
    assert by == {(d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(t)).encode()).hexdigest()) for d, t in pairs()}


def test_pipeline(spark, folder):
    docs = common.documents(spark, folder)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.written(stage(spark, kept[-1], folder), "test"))
        assert kept[-1].columns == docs.columns and kept[-1].count() <= kept[-2].count()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept[1].collect())
    assert Counter((r.doc_id, r.text) for r in kept[2].collect()) == Counter((d, x) for d, t in [(r.doc_id, r.text) for r in kept[1].collect()] if (x := slow_lines([(r.doc_id, r.text) for r in kept[1].collect()], lines.RUN)[d, t]) and (x == t or x.strip()))
    fps = np.array([slow_fingerprint(r.text) for r in kept[2].collect()], np.uint64)
    assert kept[3].count() == len(set(common.forest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)).tolist()))
    assert {r.doc_id for r in kept[3].collect()} - {r.doc_id for r in kept[4].collect()} == {18}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept[4].collect())
