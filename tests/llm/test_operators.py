"""Operators against plain versions on a small fixture, and their defined cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import common, components, imatch, jaccard, licenses, media, packing, sharding, suffix

from .conftest import texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- 1


def test_fingerprints(docs, empty, odd):
    got = by_id(imatch.fingerprint_documents(docs))
    found = texts()
    order = sorted(found, reverse=True)
    for k, i in enumerate(order):
        own, after = found[i] or "", found[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint == got[10].fingerprint and got[6].near_next == 1.0
    assert got[5].fingerprint != got[11].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert imatch.fingerprint_documents(empty).count() == 0
    assert imatch.fingerprint_documents(odd).count() == 4


def test_likeness_falls_with_edits():
    words = [f"w{i}" for i in range(300)]
    make = imatch.Fingerprinter(imatch.np.sort(imatch.hashes({w.encode() for w in words})))
    base = make.signatures(" ".join(words))
    steps = [imatch.likeness(base, make.signatures(" ".join([*words[k:], *(f"x{i}" for i in range(k))]))) for k in (0, 3, 30, 300)]
    assert steps[0] == 1.0 and steps == sorted(steps, reverse=True) and steps[1] > 0.5 and steps[-1] == 0.0


# ---------------------------------------------------------------- 2


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    places = sorted(i for s in starts.values() for i in s)
    more = set()
    sets = [set(t.split()) for t, _ in licenses.TEMPLATES]
    for own, must, (t, label) in zip(sets, licenses.told_by(sets, 0.8), licenses.TEMPLATES, strict=True):
        block = -(-10 * len(t.split()) // 8)
        if any(10 * len(own & held) >= 8 * len(own) and held.issuperset(must) for held in (set(words[i : i + block]) for i in range(len(words)))):
            more.add(label)
    base = {k for k, v in starts.items() if v}
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | more))


def test_near_relatives_are_told_apart():
    sets = [{"a", "b", "c", "d", "e", "nc"}, {"a", "b", "c", "d", "e", "sa"}, {"x", "y"}]
    assert licenses.told_by(sets, 0.8) == [["nc"], ["sa"], []]
    assert plain_scan(LICENSED[9])[5] == "" and plain_scan(LICENSED[10])[5] == "cc-by"


LICENSED = {
    1: "All rights reserved.", 2: "Licensed under CC BY-NC 4.0.\nthis work is licensed under the GNU General Public License, version 3.", 3: "gnu general public licenses", 4: None,
    5: "MIT   license, mit-license MITLICENSE", 6: "Released under\nthe MIT License", 7: "ccby cc by cc, by", 8: "permission is hereby granted, free of charge, to any person obtaining copies of this software",
    9: "We reserved a table for all guests; animal rights matter", 10: "Licensed under CC BY 4.0.",
}


def test_license_scan(spark, docs, empty, odd):
    mine = spark.createDataFrame(list(LICENSED.items()), "doc_id long, text string")
    for frame, found in ((mine, LICENSED), (docs, texts())):
        got = by_id(licenses.scan_documents(frame))
        for i, t in found.items():
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_scan(t), t
            assert (r.score > 0) == bool(r.labels) and r.score <= 1
    assert licenses.scan_documents(empty).count() == 0 and licenses.scan_documents(odd).count() == 4


WRAPPED = {
    1: ("/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that", "bsd"),
    2: ("you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published", "lgpl"),
    3: ("some words\n" * 40 + "this is free and\nunencumbered software released into\nthe public domain", "unlicense"),
    4: ("rights\n" + "some words " * 20 + "\nall " + "some words " * 20 + "\nreserved", ""),
}


def test_wrapped_notices(spark):
    got = by_id(licenses.scan_documents(spark.createDataFrame([(i, t) for i, (t, _) in WRAPPED.items()], "doc_id long, text string")))
    assert {i: r.labels for i, r in got.items()} == {i: label for i, (_, label) in WRAPPED.items()}
    assert [got[i].n_templates for i in sorted(got)] == [1, 1, 1, 0] and got[1].score == 1.0


# ---------------------------------------------------------------- 3


def test_sharding(docs, empty, odd):
    got = sharding.two_pass_shuffle(docs.select("doc_id", "source"), "doc_id", 8, bucket_rows=5)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts())
    shards = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in sharding.two_pass_shuffle(docs.repartition(5).select("doc_id", "source"), "doc_id", 8, bucket_rows=5).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.two_pass_shuffle(docs.select("doc_id"), "doc_id", 8, seed=99, bucket_rows=5).collect()}
    assert any(other[r.doc_id] != (r.shard, r.slot) for r in rows)
    full = by_id(sharding.shard_documents(docs))
    assert all(full[i].size == len((t or "").encode()) + 1 and full[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in texts().items())
    assert sharding.shard_documents(empty).count() == 0 and sharding.shard_documents(odd).count() == 4


def test_shards_are_written_whole(spark, docs, tmp_path):
    sharding.write_shards(docs, "doc_id", f"file://{tmp_path}/out", 4, bucket_rows=6)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.select("doc_id", "text", "source").exceptAll(docs.select("doc_id", "text", "source")).count() == 0 and back.count() == docs.count()


def test_digest_comes_from_written_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000, raising=False)
    out = sharding.shard_documents(docs)
    assert any("/shard=" in f for f in out.inputFiles())
    back = spark.read.parquet(out.inputFiles()[0].split("/shard=")[0])
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert {(r.doc_id, r.shard, r.slot) for r in out.collect()} == {(r.doc_id, r.shard, r.slot) for r in back.collect()}
    one_id = spark.createDataFrame([(1, "x" * 1000 + str(i)) for i in range(200)], "doc_id long, text string")
    found = sharding.two_pass_shuffle(one_id, "doc_id", 4)
    assert found.count() == 200 and found.select(F.spark_partition_id()).distinct().count() > 1


# ---------------------------------------------------------------- 4


def check_packing(rows, found):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in found.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert mine == [(k, 2048 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cuts)]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing(docs, empty, odd):
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, texts())
    assert packing.pack_documents(empty).count() == 0 and packing.pack_documents(odd).count() == 4


def test_chunk_cache_equals_whole_encoding(spark):
    hard = {1: "Don't stop... U.S.A., e.g., x,y.z !?.,", 2: "Á é. ΣΑΣ ΌΣΟΣ. İstanbul", 3: "tab\tand nbsp wide\r\nline", 4: "<|endoftext|> <|startoftext|>.", 5: "12,5. 3.14 ,. .. ,"}
    check_packing(packing.pack_documents(spark.createDataFrame(list(hard.items()), "doc_id long, text string")).collect(), hard)


def test_best_fit_rules():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    p = packing.BestFit(10, 1)
    assert [p.place(n)[0] for n in (6, 7, 3)] == [0, 1, 0]  # 7 opens a second bin; of both it is the fuller one and closes


def plain_packing(lengths, capacity, most, window):
    """(bin, offset) of each piece by trying every open bin."""
    free, used, out = {}, 0, {}
    for low in range(0, len(lengths), window):
        for i in sorted(range(low, min(low + window, len(lengths))), key=lambda i: -lengths[i]):
            fits = [(space, b) for b, space in free.items() if space >= lengths[i]]
            if fits:
                b = min(fits)[1]
            else:
                b, used = used, used + 1
                free[b] = capacity
            out[i] = (b, capacity - free[b])
            free[b] -= lengths[i]
            if not free[b]:
                del free[b]
            if len(free) > most:
                del free[min(free, key=lambda b: free[b])]
    return out, used


@pytest.mark.parametrize("most, window", [(4, 1), (4, 16), (1000, 64)])
def test_packs_as_a_plain_packer_does(spark, most, window):
    """The same number of sequences, and the same fill of each: which of two bins of one free space is taken makes no difference."""
    rng = random.Random(most + window)
    lengths = [rng.randint(1, 100) for _ in range(700)]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").coalesce(1)
    rows = packing.pack(df, "n", 100, most, window).collect()
    assert [r.n for r in rows] == lengths
    out, used = plain_packing(lengths, 100, most, window)
    fill = lambda pairs: sorted(Counter(b for b, n in pairs for _ in range(n)).values())
    assert len({r.sequence_id for r in rows}) == used
    assert fill((r.sequence_id, r.n) for r in rows) == fill((out[i][0], n) for i, n in enumerate(lengths))


def test_few_sequences(spark):
    """Within two in a hundred of the lower bound, with the production window and bound."""
    rng = random.Random(9)
    lengths = [min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "n int").coalesce(1), "n").select("sequence_id").distinct().count()
    assert rows <= 1.02 * -(-sum(lengths) // 2048)


def test_pieces_of_one_id_are_dealt_out(spark):
    """Nine in ten rows have no id and one text; no task gets more than its share."""
    same = spark.range(9000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    docs = same.unionByName(spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in packing.pack_documents(docs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 10_000 and max(parts) < 2 * 10_000 / len(parts) and len(parts) > 1


# ---------------------------------------------------------------- 5


def plain_removal(found, width, later=False):
    raw = {i: (t or "").encode() for i, t in found.items()}
    places: dict[bytes, list] = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - width + 1):
            places.setdefault(raw[i][p : p + width], []).append((i, p))
    out = {}
    for i, r in raw.items():
        cover = bytearray(len(r))
        for p in range(len(r) - width + 1):
            at = places[r[p : p + width]]
            if len(at) > 1 and (not later or at[0] != (i, p)):
                cover[p : p + width] = b"\1" * width
        kept = bytes(b for b, c in zip(r, cover, strict=True) if not c)
        out[i] = (len(r), len(r) - len(kept), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("most", [2048, 1])
def test_repeats(docs, later, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)  # 1: all contexts take the way of single windows
    got = suffix.remove_repeats(docs, later_only=later).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == plain_removal(texts(), suffix.WIDTH, later)


def plain_words(found, width, later=False):
    """Texts without repeated runs of ``width`` words, and the numbers of maximal runs covered."""
    places: dict[tuple, list] = {}
    words = {i: [m.span() for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for i, t in found.items()}
    raw = {i: (t or "").encode() for i, t in found.items()}
    window = lambda i, p: tuple(raw[i][a:b] for a, b in words[i][p : p + width])
    for i in sorted(words):
        for p in range(len(words[i]) - width + 1):
            places.setdefault(window(i, p), []).append((i, p))
    out = {}
    for i, spans in words.items():
        cover = bytearray(len(spans))
        for p in range(len(spans) - width + 1):
            at = places[window(i, p)]
            if len(at) > 1 and (not later or at[0] != (i, p)):
                cover[p : p + width] = b"\1" * width
        ends = [*(a for a, _ in spans[1:]), len(raw[i])][: len(spans)]
        gone = bytearray(len(raw[i]))
        for (a, _), z, c in zip(spans, ends, cover, strict=True):
            gone[a:z] = bytes([c]) * (z - a)
        out[i] = (bytes(b for b, g in zip(raw[i], gone, strict=True) if not g), len(re.findall(rb"\x01+", bytes(cover))))
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_repeated_words(docs, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)
    plain = plain_words(texts(), suffix.PASSAGE)
    got = by_id(suffix.remove_repeats(docs, passage=suffix.PASSAGE))
    assert {i: r.n_passages for i, r in got.items()} == {i: n for i, (_, n) in plain.items()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == plain_removal(texts(), suffix.WIDTH)
    plain = plain_words(texts(), suffix.PASSAGE, later=True)
    got = by_id(suffix.remove_repeats(docs, suffix.PASSAGE, later_only=True, keep_text=True, words=True))
    assert {i: bytes(r.kept) for i, r in got.items()} == {i: t for i, (t, _) in plain.items()}


def test_repeats_defined_cases(empty, odd):
    assert suffix.remove_repeats(empty).count() == 0
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == 4 and all(r.n_removed == r.n_bytes for r in got if r.n_bytes > 400)


def test_later_copies_go(docs):
    kept = by_id(suffix.drop_later_copies(docs))
    assert kept[5].text == texts()[5] and 6 not in kept and kept[0].text is None
    assert kept[12].n_chars == len(kept[12].text) < len(texts()[12]) and kept[12].component == 9


@pytest.mark.parametrize("data", [b"abracadabra-abracadabra", b"aaaaaaaaaaaaaaaa", b"mississippi mississippi", bytes(range(40)) * 2, b"x"])
@pytest.mark.parametrize("depth", [1, 3, 5, 12, 64])
def test_suffix_order_and_previous_factors(data, depth):
    np, n = suffix.np, len(data)
    for array in (np.frombuffer(data, np.uint8), np.frombuffer(data, np.uint8).astype(np.uint64) << np.uint64(50)):
        levels = suffix.ranks_by_depth(array, depth)
        order = suffix.suffix_order(levels[-1][1])
        assert order.tolist() == sorted(range(n), key=lambda i: (data[i : i + depth], i))
        plain = [max([0, *(k for j in range(i) for k in range(1, min(depth, n - i) + 1) if data[j : j + k] == data[i : i + k])]) for i in range(n)]
        lengths, sources = suffix.longest_previous_factor(levels, array, np.arange(n))
        assert lengths.tolist() == plain and all(data[j : j + k] == data[i : i + k] and j < i for i, (j, k) in enumerate(zip(sources, plain, strict=True)) if k)
        if n > depth:
            starts = np.arange(n - depth + 1)
            assert suffix.repeated_starts(array, starts, depth, True).tolist() == [plain[i] >= depth for i in starts]
            windows = [data[i : i + depth] for i in starts]
            assert suffix.repeated_starts(array, starts, depth, False).tolist() == [windows.count(w) > 1 for w in windows]


def test_previous_smaller():
    rng = random.Random(3)
    for values in ([rng.randrange(50) for _ in range(300)], list(range(100)), list(range(100, 0, -1)), [], [1]):
        plain = [max([j for j in range(i) if values[j] < v], default=-1) for i, v in enumerate(values)]
        assert suffix.previous_smaller(suffix.np.array(values, suffix.np.int64)).tolist() == plain


def test_runs_of_long_texts_do_not_depend_on_parts(monkeypatch):
    raw = (texts()[16] or "").encode()
    symbols = suffix.BYTES.symbols(raw)
    whole = [x.tolist() for x in suffix.anchor_runs(symbols)]
    monkeypatch.setattr(suffix, "PART", 1000)
    assert [x.tolist() for x in suffix.anchor_runs(symbols)] == whole
    monkeypatch.setattr(suffix, "PART", 100)
    assert suffix.word_symbols(raw).tolist() == [int(suffix.range_hashes(suffix.np.frombuffer(w, suffix.np.uint8), suffix.np.array([0]), suffix.np.array([len(w)]))[0]) for w in raw.split()]


# ---------------------------------------------------------------- 9


def test_media(spark, docs, empty, odd):
    got = by_id(media.media_documents(docs))
    for i, t in texts().items():
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        stored = media.encode_png(padded)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.features(padded))
    assert media.media_documents(empty).count() == 0 and media.media_documents(odd).count() == 4


def test_archive_ranges_and_retries(spark, docs, tmp_path):
    path = f"file://{tmp_path}/a"
    media.store_documents(docs.coalesce(1), path)
    small = spark.read.format("media_archive").option("range_bytes", 200).load(path)
    assert small.rdd.getNumPartitions() > 3 and small.count() == docs.count()
    reader = media.ArchiveReader(path, 1 << 20, 3)
    part = reader.partitions()[0]
    tries = []

    class Flaky:
        def open_input_file(self, file):
            tries.append(file)
            if len(tries) < 3:
                raise OSError("lost")
            return media.filesystem(path)[0].open_input_file(file)

    first = next(reader.read(part))
    body = first.column(2)[0].as_py()
    assert reader.member(Flaky(), part.file, 0, len(body), zlib.crc32(body)) == body and len(tries) == 3
    with pytest.raises(OSError):
        reader.member(media.filesystem(path)[0], part.file, 0, len(body), 1)
    with pytest.raises(ValueError):
        media.decode_png(body[:-20] + bytes(20))


# ---------------------------------------------------------------- 10


def plain_links(found, n=5, percent=75):
    sets = {}
    for i, t in found.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [75, 50])
def test_jaccard(docs, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, percent=percent).collect()}
    assert got == plain_links(texts(), percent=percent)


def one_group_triple():
    """1, 2 and 3 have one size and one prefix that no other text has; only 2 and 3 are near copies."""
    for k in range(100_000):
        a, b, c = (f"a b c d e{k} f {x}" for x in (f"v w x y{k} z", f"p q r s{k} t", f"p q r s{k} u"))
        order = [jaccard.np.sort(jaccard.ngram_set(t.encode()) >> jaccard.np.uint64(6))[: jaccard.prefix_size(7)].tolist() for t in (a, b, c)]
        if order[0] == order[1] == order[2]:
            return {1: a, 2: b, 3: c}


def test_jaccard_links_inside_a_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "count_classes", lambda docs, n: jaccard.np.zeros(jaccard.BUCKETS, jaccard.np.uint8))  # any order gives the same result
    found = one_group_triple()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(found.items()), "doc_id long, text string")).collect()}
    assert got == plain_links(found) == {1: (7, 1), 2: (7, 2), 3: (7, 2)}


def test_jaccard_defined_cases(docs, empty, odd):
    assert jaccard.near_duplicates(empty).count() == 0
    got = jaccard.near_duplicates(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(False, 1, 1), (False, 1, 1), (False, 2, 2)]
    kept = sorted(r.doc_id for r in jaccard.keep_first(docs).collect())
    assert kept == sorted({c for i, (_, c) in plain_links(texts()).items()})


def test_overlap_bound_is_never_too_small():
    rng = jaccard.np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 6000).astype(jaccard.np.uint64)
    for _ in range(50):
        a, b = (jaccard.np.unique(rng.choice(pool, rng.integers(1, 3000))) for _ in range(2))
        assert jaccard.largest_overlap(len(a), jaccard.parity_table(a), len(b), jaccard.parity_table(b)) >= len(jaccard.np.intersect1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {k: v for k, v in got.items() if k not in (0, 100, 200)} == {**{i: 0 for i in range(1, 41)}, 101: 100, **{i: 200 for i in range(201, 260)}}
    assert all(got.get(k, k) == k for k in (0, 100, 200))


# ---------------------------------------------------------------- shared


def test_written_tables_and_folder(spark):
    df = common.materialize(spark.range(10), "t")
    assert df.count() == 10 and common.shared_folder(spark) in df.inputFiles()[0].replace("file:///", "file:///")
    assert Counter(r.id % 2 for r in df.where(F.col("id") > 3).collect()) == {0: 3, 1: 3}


def test_a_null_id_is_not_another_documents_minus_one(spark):
    rng = random.Random(2)
    same = "".join(rng.choice("abcdefgh") for _ in range(700))
    df = spark.createDataFrame([(None, same), (-1, same), (-1, "short"), (4, "other")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(df).collect()}
    assert got == {(None, 700, 700), (-1, 700, 700), (-1, 5, 0), (4, 5, 0)}
    kept = suffix.drop_later_copies(df, 200, words=False).collect()  # null counts as -1 in the order, so either copy may be the first
    assert sorted(r.text for r in kept) == sorted([same, "short", "other"])


def test_shards_take_maps_and_variants(spark):
    df = spark.sql("select id as doc_id, concat('t', id % 3) as text, map('k', id) as m, parse_json('[1]') as v, array(map(1, id)) as a, id as shard from range(50)")
    got = sharding.two_pass_shuffle(df, "doc_id", 4, bucket_rows=8)
    assert got.columns == ["doc_id", "text", "m", "v", "a", "_shard", "shard", "slot"]
    rows = got.select("doc_id", "m", "a", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == list(range(50)) and all(r.m == {"k": r.doc_id} and r.a == [{1: r.doc_id}] for r in rows)
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(len([1 for r in rows if r.shard == k])))
    assert max(sum(r.shard == k for r in rows) for k in range(4)) - min(sum(r.shard == k for r in rows) for k in range(4)) <= 1
