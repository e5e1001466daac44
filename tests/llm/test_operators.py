import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_equal_sql
from corpus import awkward, documents, words
from pyspark.sql import functions as F

from stackloom.llm import sql, warc
from stackloom.llm.chat_format import rotate_perspectives, whole_dialogues
from stackloom.llm.decontamination import benchmark_leaks, decontaminate, lcs_length
from stackloom.llm.jaccard_join import _live, near_duplicate_components
from stackloom.llm.line_dedup import dedup_lines
from stackloom.llm.mixing import mix, mix_plan
from stackloom.llm.quality_crf import forward_backward, score_quality, train
from stackloom.llm.quality_rules import quality_rules
from stackloom.llm.queries import ORACLE_SQL, QUERIES
from stackloom.llm.scratch import Scratch
from stackloom.llm.suffix_dedup import positional_transform, remove_repeats
from stackloom.llm.token_packing import END_OF_TEXT, RoomTree, best_fit_decreasing, encoder, matrix, pack_tokens, read_binary, write_binary

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    rows_equal_sql(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_empty_tables_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert near_duplicate_components(empty).count() == 0
    assert pack_tokens(empty).count() == 0
    assert quality_rules(empty).count() == 0
    assert mix_plan(empty).count() == 0 and mix(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert dedup_lines(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_leaks(empty, bench).count() == 0
    some = documents(spark, [(1, "a b c d", "s")])
    assert benchmark_leaks(some, bench).count() == 0 and decontaminate(some, bench).count() == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_quality(some, train(some, labels)).collect()] == [0.5]
    odd = some
    for c in ("t", "w", "sid", "n", "key", "copies", "lines", "bits", "size", "quality_", "`", "tid"):
        odd = odd.withColumn(c.replace("`", "q"), F.lit("x"))
    assert near_duplicate_components(odd).count() == 1 and mix(odd).count() >= 0
    assert quality_rules(odd).columns == [*odd.columns, "quality"]
    assert mix(odd).columns == odd.columns and remove_repeats(odd).count() == dedup_lines(odd).count() == pack_tokens(odd).count() == 1


def brute_components(rows, k, num, den):
    sets = []
    for _, text, _ in rows:
        w = split(lower(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0] if r[0] is not None else math.inf)
    return sorted(((r[0], len(sets[i]), None if min(least[find(i)]) == math.inf else min(least[find(i)])) for i, r in enumerate(rows)), key=key)


@pytest.mark.parametrize(("k", "num", "tile"), [(4, 85, 4096), (5, 80, 2), (2, 60, 3)])
def test_components_by_brute_force(spark, k, num, tile):
    rng = random.Random(num)
    rows = awkward(num)
    base = words(rng, 60)
    for i in range(100, 130):
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(60)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(near).upper() if i % 2 else " ".join(near), "s"))
    got = near_duplicate_components(documents(spark, rows), k, num, 100, tile_rows=tile)
    assert sorted(map(tuple, got.collect()), key=key) == brute_components(rows, k, num, 100)


def postings(tok, n, pos):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (tok, np.arange(len(n)), np.asarray(n) << 32 | np.asarray(pos))], ["tok", "sid", "size"])


def test_live_postings_of_one_long_token():
    """An early row, then more late rows of its size than were ever held at once: all of them can link with it."""
    rows, step = 4_500_000, 500_000
    pos = np.full(rows, 30)
    pos[0] = 0
    batches = (postings(np.zeros(step), np.full(step, 100), pos[k : k + step]) for k in range(0, rows, step))
    assert sum(b.num_rows for b in _live(85, 100)(batches)) == rows


@pytest.mark.parametrize("run_rows", [1, 2, 7, 10**6])
def test_live_postings_by_brute_force(run_rows):
    rng = random.Random(run_rows)
    for _ in range(40):
        rows = sorted((rng.randrange(4), rng.choice([20, 22, 26, 40, 60]), rng.randrange(14)) for _ in range(60))
        early = [p <= n - -(-170 * n // 185) for _, n, p in rows]
        want = set()
        for j in range(60):
            for i in range(j):
                if rows[i][0] == rows[j][0] and early[i] and rows[j][1] * 85 <= rows[i][1] * 100:
                    want |= {i, j}
        whole, batches, at = postings(*zip(*rows, strict=True)), [], 0
        while at < 60:
            size = rng.randrange(0, 9)
            batches.append(whole.slice(at, size))
            at += size
        got = [x for b in _live(85, 100, run_rows)(iter(batches)) for x in b.column("sid").to_pylist()]
        assert got == sorted(want)


def test_quality_rules(spark):
    prose = "\n".join(" ".join(f"plain{w}word{i}" for i in range(12)) + "." for w in "one two three four five six".split())
    junk = "\n".join(" | ".join(f"a{i}{j}" for j in range(12)) for i in range(10))
    shout = "\n".join(" ".join(f"WORD{chr(65 + i)}{chr(65 + j)}!!" for j in range(12)) for i in range(6))
    rows = [(1, prose, "s"), (2, junk, "s"), (3, shout, "s"), (4, None, "s"), (5, "Und " * 200, "s"), (6, prose + "\nAll rights reserved.", "s"), (6, prose + "\nAll rights reserved.", "s")]
    got = sorted((r.doc_id, r.quality.kept, r.quality.clean_text) for r in quality_rules(documents(spark, rows)).collect())
    assert [(i, k) for i, k, _ in got] == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True)]
    assert got[-1][2] == prose and got[3][2] == ""
    q = {r.doc_id: r.quality for r in quality_rules(documents(spark, awkward())).collect()}
    for i, text, _ in awkward():
        w = split(text)
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {p for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        if i is not None:
            assert (q[i].n_words, q[i].word_chars, q[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))


def test_quality_rules_beside_a_column_of_their_name(spark):
    docs = documents(spark, [(1, "a b c. " * 30, "s"), (2, None, "t")])
    for c in ("quality", "Quality_", "__quality_rules", "kept"):
        docs = docs.withColumn(c, F.lit("own"))
    out = quality_rules(docs)
    assert out.columns[:-1] == docs.columns and out.columns[-1] == "quality__"
    assert [r["quality"] for r in out.collect()] == ["own", "own"]
    plan = out.filter(F.col("source") == "s").select("doc_id")._jdf.queryExecution().toString()
    assert "source" in plan[plan.rindex("Filter") :] or "PushedFilters: [IsNotNull(source)" in plan


def test_repeated_windows_where_hashes_coincide(spark, monkeypatch):
    """Windows that hash alike, all of them here, are told apart by their words."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0 + 5)
    rng = random.Random(3)
    rows = [(k, " ".join(words(rng, n, pool)), "s") for k, (n, pool) in enumerate(((60, 4), (200, 30), (50, 1000), (3, 1), (4, 1), (7, 2)))]
    for r in quality_rules(documents(spark, rows)).collect():
        w = split(r.text)
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        assert r.quality.n_repeat_words == len({p for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)})


def test_boilerplate_by_share(spark):
    prose = "\n".join(" ".join(f"plain{w}word{i}" for i in range(12)) + "." for w in "one two three four five six".split())
    line = "All rights reserved. " * 30
    mention = "This sentence mentions a privacy policy " + "and goes on at length " * 20 + "until its end."
    got = quality_rules(documents(spark, [(1, f"{prose}\n{line}\n{mention}\nAlle Rechte vorbehalten.", "s")])).first().quality.clean_text
    assert got == f"{prose}\n{mention}"


def test_mixing_by_brute_force(spark):
    rows = awkward() + [(200 + k, "w " * (k + 1), f"t{k % 3}") for k in range(60)]
    docs = documents(spark, rows)
    for bins in (4096, 2):
        got = mix_plan(docs, bins=bins).collect()
        size = defaultdict(int)
        for _, t, s in rows:
            size[s] += len(split(t))
        order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
        while True:
            total = sum(weight[s] for s in open_)
            full = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
            if not full:
                target |= {s: left * weight[s] / total for s in open_}
                break
            target |= {s: 2.0 * size[s] for s in full}
            left -= sum(2 * size[s] for s in full)
            open_ -= full
        taken = defaultdict(int)
        for r in got:
            assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
            assert r.taken in (r.size * e for e in range(3))
            taken[r.source] += r.taken
        biggest = {s: max(len(split(t)) for _, t, x in rows if x == s) for s in size}
        assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)
    again = mix_plan(docs).collect()
    assert sorted(map(key, mix_plan(docs.repartition(3)).collect())) == sorted(map(key, again))
    copies = Counter()
    for r in again:
        copies[r.doc_id] = max(copies[r.doc_id], r.copies)
    per = Counter(r.doc_id for r in mix(docs).collect())
    times = Counter(i for i, _, _ in rows)
    assert all(per[i] == copies[i] * times[i] for i in per if i is not None)


def test_packing_round_trip(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = pack_tokens(documents(spark, rows), capacity=64, block_tokens=700).collect()
    pieces = defaultdict(list)
    for r in got:
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and len(r.doc_ids) == len(r.cu_seqlens) - 1
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[d].append((k, ids[a:b].tolist()))
            assert at[a:b].tolist() == list(range(b - a))
    assert matrix(got, 64).shape == (len(got), 64)
    texts = {i: t or "" for i, t, _ in rows}
    times = Counter(i for i, _, _ in rows)
    for d, some in pieces.items():
        one = [x for k in range(len(some) // times[d]) for x in sorted(some)[k * times[d]][1]]
        assert one[-1] == END_OF_TEXT and encoder().decode(one[:-1]) == texts[d]
    assert set(pieces) == set(texts)


def test_binary_files_round_trip(spark):
    scratch = Scratch(spark, "packed")
    packed = scratch.write(pack_tokens(documents(spark, awkward()).repartition(3), capacity=128), "rows")
    manifest = scratch.write(write_binary(packed, f"{scratch.path}/bin"), "manifest").collect()
    want = Counter((bytes(r.input_ids), bytes(r.position_ids), tuple(r.cu_seqlens)) for r in packed.collect())
    got = Counter()
    for e in manifest:
        ids, at, ends = read_binary(f"{scratch.path}/bin", e, 128)
        assert len(ids) == len(at) == len(ends) == e.rows and sum(map(len, ends)) == e.rows + e.segments
        got.update((a.tobytes(), b.tobytes(), tuple(c.tolist())) for a, b, c in zip(ids, at, ends, strict=True))
    assert got == want
    assert write_binary(pack_tokens(documents(spark, [])), f"{scratch.path}/none").count() == 0


def test_best_fit():
    rng = random.Random(5)
    lengths = np.array([rng.randrange(1, 101) for _ in range(300)])
    rows, room, want = best_fit_decreasing(lengths, 100), [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [(r, -k) for k, r in enumerate(room) if r >= lengths[i]]
        least = min((r for r, _ in fits), default=None)
        if least is None:
            room.append(100 - lengths[i])
        else:
            room[room.index(least)] -= lengths[i]
    want = len(room)
    assert len(rows) == want and sorted(i for r in rows for i in r) == list(range(300)) and all(lengths[r].sum() <= 100 for r in rows)
    tree = RoomTree(10)
    assert tree.take(1) is None
    tree.add(7, 1)
    tree.add(3, 2)
    assert tree.take(4) == (7, 1) and tree.take(4) is None and tree.take(3) == (3, 2) and tree.take(0) is None


def brute_repeats(rows, n):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    count = Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("length", "gram", "hot"), [(40, 12, 10**6), (40, 12, 1), (40, 12, 2), (40, 12, 5), (200, 48, 10**6), (200, 48, 3)])
def test_repeats_by_brute_force(spark, length, gram, hot):
    rows = awkward(length) + [(70, "Und " * 300, "s"), (71, "ab" * 19 + "c", "s"), (72, "x" * 39, "s"), (73, "x" * 41, "s")]
    passage = "".join(chr(97 + (7 * k * k + k // 3) % 26) for k in range(3 * length))
    rng = random.Random(length)
    rows += [(200 + k, f"{rng.randrange(10)}{passage[: rng.choice([length, 2 * length, 3 * length])]}{rng.randrange(10**6)}", "s") for k in range(40)]
    docs = documents(spark, rows)
    for c in ("tid", "t", "key", "win", "copies", "live", "own", "s", "e"):
        docs = docs.withColumn(c, F.lit("x"))
    got = remove_repeats(docs, length, gram, hot_windows=hot, keep_bytes=False)
    assert sorted(map(tuple, got.collect()), key=key) == brute_repeats(rows, length)


def test_positional_transform(tmp_path):
    rng = np.random.default_rng(1)
    for _ in range(30):
        group = np.sort(rng.integers(0, 4, 20))
        group = np.unique(group, return_inverse=True)[1]
        s = np.where(rng.random((20, 25)) < 0.1, rng.integers(0, 3, (20, 25)), rng.integers(0, 3, (4, 25))[group % 4]).astype(np.int16)
        s[rng.random(20) < 0.4, : rng.integers(0, 12)] = 256
        got = positional_transform(s, group, 5, f"file://{tmp_path}", block=int(rng.integers(1, 30)))
        assert not list(tmp_path.iterdir())
        for i in range(20):
            for k in range(25):
                w = s[i, max(k - 4, 0) : k + 1]
                want = k >= 4 and not (w == 256).any() and any(j != i and group[j] == group[i] and (s[j, k - 4 : k + 1] == w).all() for j in range(20))
                assert got[i, k] == want


@pytest.mark.parametrize(("slice_lines", "bits", "parts"), [(1 << 22, 16, 1), (5, 16, 7), (1 << 22, 0, 3), (7, 0, 20)])
def test_line_dedup_by_brute_force(spark, slice_lines, bits, parts):
    """Many slices and few, filters that pass everything, documents of one key or id in one group and in several."""
    rows = awkward() + [(80 + k, f"  Shared LINE number {k % 2} of some length \nown {k}\n\n  shared line number {k % 2} of some length", "s") for k in range(8)]
    rows += [(90, "ééééééééééééééééééé\n" + "é" * 20, "s"), (91, "é" * 20, "s"), (92, "\t" + "é" * 20, "s")]
    rows += [(i, "a line that documents of one id share", "s") for i in (100, 100, 101)] + [(i, "a line of three documents, one of them null", "s") for i in (None, None, 102, 103)]
    rows += [(2**63 - 1, "the line of the largest and the least id", "s"), (-(2**63), "the line of the largest and the least id", "s"), (None, "the line of the largest and the least id", "s")]
    keyed = lambda t: [lower(x.strip(SPACE)) for x in (t or "").split("\n")]
    held = defaultdict(set)
    low = -(2**63) - 1
    for i, t, _ in rows:
        for x in keyed(t):
            if len(x) >= 20:
                held[x].add(low if i is None else i)
    bad = {x: max(ids) for x, ids in held.items() if len(ids) >= 3}
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keyed(t), strict=True) if k not in bad or bad[k] == (low if i is None else i)]
        want.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    docs = documents(spark, rows).repartition(parts)
    for c in ("t", "grp", "key", "files", "drops", "last", "none", "slice"):
        docs = docs.withColumn(c, F.lit("x"))
    got = dedup_lines(docs, slice_lines=slice_lines, bits_a_line=bits, keep_text=False)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_warc_round_trip(spark):
    rng = random.Random(6)
    pages = [(k, f"http://h/{k}", "".join(rng.choice("ab<>é\n") for _ in range(rng.choice([0, 5, 3000])))) for k in range(60)]
    nested = warc._member(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 1).decode("latin-1")
    pages += [(60, None, None), (61, "http://a b\n", "x" * 100_000), (62, "u", pages[3][2]), (63, "u", nested), (None, "u", "null id"), (64, "u", "null id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = Scratch(spark, "warc-test")
    folder = f"{scratch.path}/a"
    manifest = scratch.write(warc.write_archives(df.repartition(2), folder), "m")
    first = {}
    for i, _, h in pages:
        h = (h or "").encode()
        first[h] = min(first.get(h, math.inf), math.inf if i is None else i)
    want = sorted(((i, len(b := (h or "").encode()), warc.base32_digest(b), "response" if (math.inf if i is None else i) == first[b] else "revisit", None if (math.inf if i is None else i) == first[b] else first[b]) for i, _, h in pages), key=key)
    for size in (1, 777, 1 << 30):
        back = warc.read_archives(spark, manifest, folder, size).filter("digest_ok").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") if size > 1 else None
        if back is not None:
            assert sorted(map(tuple, back.collect()), key=key) == want
    payload = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, manifest, folder).filter("record_type = 'response'").collect()}
    assert all(payload.get(i, h or "") == (h or "") for i, _, h in pages)
    assert all("revisit" != r.record_type for r in warc.read_archives(spark, scratch.write(warc.write_archives(df, folder + "2", min_bytes=10**9), "m2"), folder + "2").collect())


def test_warc_ranges_are_dealt_to_tasks(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(k, "u", "".join(rng.choice("abcdefgh") for _ in range(4000))) for k in range(200)], "page_id long, url string, html string")
    scratch = Scratch(spark, "warc-tasks")
    manifest = scratch.write(warc.write_archives(df.coalesce(1), f"{scratch.path}/a"), "m")
    back = warc.read_archives(spark, manifest, f"{scratch.path}/a", 4096)
    ranges = manifest.selectExpr("sum(ceil(size / 4096))").first()[0]
    tasks = [x for x in back.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect() if x["count"]]
    assert ranges > 60 and back.rdd.getNumPartitions() == ranges // warc.RANGES_A_TASK and len(tasks) > ranges // 10 and sum(x["count"] for x in tasks) == 200


def test_warc_damage_is_found(spark):
    df = spark.createDataFrame([(k, None, f"payload {k} " * 300) for k in range(30)], "page_id long, url string, html string")
    scratch = Scratch(spark, "warc-damage")
    folder = f"{scratch.path}/a"
    manifest = scratch.write(warc.write_archives(df.coalesce(1), folder), "m")
    path, size = manifest.first()[:2]
    places = [r.offset for r in warc.read_archives(spark, manifest, folder).orderBy("offset").collect()]
    whole = open(path, "rb").read()
    for at in (places[0], places[7], places[-1]):
        open(path, "wb").write(whole[: at + 30] + b"\0\0\0\0" + whole[at + 34 :])
        for split in (300, 1 << 20):
            got = warc.read_archives(spark, manifest, folder, split, damaged="row").collect()
            assert [r.offset for r in got if r.record_type == "damaged"] == [at] and len(got) == 30
            assert warc.read_archives(spark, manifest, folder, split, damaged="skip").count() == 29
            with pytest.raises(Exception, match="no record can be read"):
                warc.read_archives(spark, manifest, folder, split).count()
    open(path, "wb").write(whole)
    # a record whose payload is another one than its digest says
    bad = warc._member(warc.record(5, None, b"abc", 3, warc.base32_digest(b"abd"), "2024-01-01T00:00:00Z"), 1)
    open(path, "ab").write(bad)
    longer = spark.createDataFrame([(path, size + len(bad))], "path string, size long")
    assert [r.page_id for r in warc.read_archives(spark, longer, folder, damaged="row").filter("not digest_ok").collect()] == [5]
    with pytest.raises(Exception, match="not the one its headers"):
        warc.read_archives(spark, longer, folder).count()


def test_warc_edge_cases(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = [(None, "u", "x" * 50), (None, "v", "x" * 50), (3, "w", "y"), (None, "w", "y"), (2**63 - 1, "w", "y"), (7, None, None)]
    odd = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("size", "path", "digest", "member", "first", "sha", "n", "own"):
        odd = odd.withColumn(c, F.lit("x"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(odd).collect()), key=key)
    assert got == sorted([(None, "response", None, 50), (None, "response", None, 50), (3, "response", None, 1), (None, "revisit", 3, 1), (2**63 - 1, "revisit", 3, 1), (7, "response", None, 0)], key=key)


def test_chat_formatting(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "bob", "Yo"), (1, 3, "user", None), (2, None, None, "x"), (3, 0, "system", "s"), (None, 1, "user", "n"), (None, 1, "user", "n")]
    got = {(r.conv_id, r.speaker): r for r in rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("s", F.lit(1))).collect()}
    assert set(got) == {(1, "user"), (1, "bob"), (2, "unknown"), (None, "user")}
    r = got[1, "user"]
    assert r.rendered == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nYo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    cut = [r.rendered[int(a) : int(b)] for a, b in (x.split("-") for x in r.mask.split(","))]
    assert cut == ["Hi<|im_end|>", "<|im_end|>"] and r.n_target_chars == sum(map(len, cut))
    assert got[1, "bob"].rendered.count("assistant") == 1 and got[None, "user"].n_turns == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rotate_perspectives(empty).count() == 0 and whole_dialogues(rotate_perspectives(empty)).count() == 0


def brute_dialogues(turns):
    """Whole renderings and masks, without parts."""
    out = {}
    for conv in {x[0] for x in turns}:
        own = sorted(((n is not None, n or 0), r or "unknown", t or "") for c, n, r, t in turns if c == conv)
        for speaker in {r for _, r, _ in own} - {"system"}:
            text, mask = "", []
            for _, r, t in own:
                who = "assistant" if r == speaker else r if r == "system" else f"user name={r}"
                text += f"<|im_start|>{who}\n"
                if r == speaker:
                    mask.append(f"{len(text)}-{len(text) + len(t) + len('<|im_end|>')}")
                text += f"{t}<|im_end|>\n"
            out[conv, speaker] = (len(own), text, ",".join(mask))
    return out


@pytest.mark.parametrize("part_turns", [1, 3, 64])
def test_whole_dialogues_by_brute_force(spark, part_turns):
    """Long dialogues, one that holds most turns, missing and shared turn numbers, repeated turns, long and null texts."""
    rng = random.Random(part_turns)
    names = ["system", "ann", "bob", "user", "Zoë", None]
    turns = [(7, rng.choice([None, *range(300)]), rng.choice(names), rng.choice([None, "", "é" * rng.randrange(9), "tie"])) for _ in range(500)]
    turns += [(c, k, names[k % 5], f"t{k}") for c in (1, 2, None) for k in range(rng.randrange(60, 140))]
    turns += [(3, 5, "ann", "same")] * 150 + [(4, 1, "bob", "word " * 40_000), (5, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in ("rn", "part", "seq", "piece", "start", "speaker", "conv", "own"):
        df = df.withColumn(c, F.lit("x"))
    parts = rotate_perspectives(df.repartition(5), part_turns=part_turns)
    rows = parts.collect()
    assert max(r.n_turns for r in rows) <= part_turns
    want = brute_dialogues(turns)
    assert all(want[r.conv_id, r.speaker][1][r.start : r.start + len(r.rendered)] == r.rendered for r in rows)
    assert {(r.conv_id, r.speaker): (r.n_turns, r.rendered, r["mask"]) for r in whole_dialogues(parts).collect()} == want


def test_forward_backward():
    rng = np.random.default_rng(2)
    e, t, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    p, pairs, log_z = forward_backward(e, t, first)
    want, total, edge = np.zeros(7), 0.0, np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, z, own, tr = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum((e[a + k] / 2) * (1 if y[k] else -1) for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            own += w * np.array(y)
            for k in range(n - 1):
                tr[y[k], y[k + 1]] += w
        want[a:b], total, edge = own / z, total + math.log(z), edge + tr / z
    assert np.allclose(p, want) and np.allclose(pairs, edge) and abs(log_z - total) < 1e-9


def test_quality_classifier(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = train(d, labels)
    got = score_quality(d, model).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and len(got) > 50
    odd = score_quality(documents(spark, awkward()), model).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert not any(r.held_out for r in odd if r.doc_id is None)


def test_training_sample(spark):
    """Ids that stand in many rows train once, and the bound on bytes holds whole texts."""
    good, bad = "\n".join(["Plain words make a sentence here."] * 3), "\n".join(["#|#|$$ @@ ||| ***"] * 3)
    rows = [(k, (good if k % 2 else bad) + f"\nline {k}.", "s") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    once = train(documents(spark, rows), labels)
    again = train(documents(spark, rows + rows[:30] * 50 + [(2, None, "s")] * 3).withColumn("k", F.lit("x")).withColumn("label", F.lit(7)), labels, max_docs=10**6)
    assert np.allclose(once.w, again.w, atol=0.2) and train(documents(spark, rows), labels, max_bytes=0) == 0.5
    assert sorted(r.score for r in score_quality(documents(spark, rows[:1] * 3 + [(9, None, "s")]), once).collect())[0] < 0.5


def test_leaks(spark):
    rng = random.Random(7)
    item = lambda n: " ".join(words(rng, n, 3000)).capitalize() + ". " + " ".join(words(rng, 6, 3000)) + "."
    items = [(k, item(n)) for k, n in enumerate((12, 20, 40, 55))] + [(9, None), (10, "")]
    filler = lambda n: " ".join(words(rng, n, 3000))
    rows = [(k, f"{filler(50)} {t} {filler(90)}", "s") for k, t in items[:4]]
    rows += [(10 + k, f"{filler(31)}\n{t.upper()}", "s") for k, t in items[:4]]
    para = items[2][1].split()
    for k in range(3, len(para) - 8, 7):
        para[k] = "other"
    rows += [(30, f"{filler(20)} {' '.join(para)} {filler(20)}", "s"), (40, items[3][1], "s"), (40, items[3][1], "s")]
    rows += [(100 + k, filler(rng.choice([5, 70, 300])), "s") for k in range(60)] + [(200, None, "s"), (201, "", "s"), (None, items[1][1], "s")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("cosine", F.lit(1))
    got = sorted({(r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).collect()}, key=key)
    assert got == sorted({*((k, k) for k in range(4)), *((10 + k, k) for k in range(4)), (30, 2), (40, 3), (None, 1)}, key=key)
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {*range(100, 160), 200, 201}
    assert lcs_length(np.array([1, 2, 3, 4]), np.array([2, 9, 3, 1, 4])) == 3
    assert sql.OP3


def test_leaks_of_items_with_few_distinct_words(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(words(rng, n, 3000))
    grid = "\n".join(" ".join(rng.choice("123") for _ in range(9)) for _ in range(9))
    shots = " ".join(f"question {x} answer {y}" for x, y in (rng.choice([("left", "right"), ("up", "down"), ("hot", "cold")]) for _ in range(12)))
    table = "\n".join(f"| {rng.choice(['yes', 'no'])} | {rng.choice(['high', 'low'])} | 10 |" for _ in range(30))
    items = list(enumerate((grid, shots, table)))
    assert all(len(set(t.replace("|", " ").split())) < 0.3 * len(t.replace("|", " ").split()) for _, t in items)
    rows = [(k, f"{filler(40)}\n{t}\n{filler(60)}", "s") for k, t in items] + [(100 + k, filler(200), "s") for k in range(60)]
    got = benchmark_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.lcs_share) for r in got} == {(k, k, 1.0) for k in range(3)}


def test_short_paraphrases_at_all_offsets(spark):
    """With every window over the threshold, what brute force finds is found."""
    rng = random.Random(9)
    items, rows = [], []
    for m in range(12, 25):
        for offset in range(8):
            item, i = words(rng, m, 3000), len(items)
            kept = set(rng.sample(range(m), -(-6 * m // 10)))
            other = [w if k in kept else f"other{k}" for k, w in enumerate(item)]
            items.append((i, " ".join(item)))
            rows.append((i, " ".join(words(rng, 40 + offset, 3000) + other + words(rng, 60, 3000)), "s"))
    got = benchmark_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), cosine=-1.0).collect()

    def common(x, y):
        best = [0] * (len(y) + 1)
        for a in x:
            above = list(best)
            for k, b in enumerate(y):
                best[k + 1] = above[k] + 1 if a == b else max(above[k + 1], best[k])
        return best[-1]

    assert all(10 * common(t.split(), r[1].split()) >= 6 * len(t.split()) for (_, t), r in zip(items, rows, strict=True))
    assert {(k, k) for k in range(len(items))} <= {(r.doc_id, r.item_id) for r in got}


def test_mix_of_rows_that_share_an_id(spark):
    """Null and repeated ids with texts of one size, some of the same words: each row as often as its own place in the plan says."""
    rng = random.Random(10)
    rows = [(rng.choice([None, 1, 2]), " ".join(words(rng, 5)), rng.choice(["s", "t", None])) for _ in range(90)]
    rows += [(i, t, s) for i in (None, 3) for s in ("s", "t") for t in ("a a b b 1", "a b a b 1", "1 a b a b", "b b a a 1")]
    docs = documents(spark, rows)
    plan, got = mix_plan(docs).collect(), mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.copies
    assert +want == Counter((r.doc_id, r.source, len(split(r.text))) for r in got)
    times = Counter(rows)
    assert all(n % times[x] == 0 and n <= 2 * times[x] for x, n in Counter((r.doc_id, r.text, r.source) for r in got).items())
