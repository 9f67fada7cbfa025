"""Chat formatting, centroid clustering and the Merkle manifest against brute force and on odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import chat_format, manifest, orchard


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


# chat formatting

PIECES = ["[INST]", "[INST] ", " [/INST]", "<s>", "</s>", "\\", "\\\\", "[", "<", "[ROLE]", "[TEXT]", "[/ROLE]", "x", " ", "\n", "é", "[/SYS]", "[SYS]", "<s", "/INST]", "日本"]


def test_any_texts_are_read_back():
    rng, writer, reader = random.Random(5), chat_format.Writer(chat_format.Template()), chat_format.Reader(chat_format.Template())
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "us\\er[TEXT]", "[/ROLE]"]), "".join(rng.choices(PIECES, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        assert list(reader.turns("".join(t for role, text in turns for t, _ in writer.segments(role, text)))) == turns


def test_machine_counts_turns_out_of_order():
    def run(*roles):
        m = chat_format.Machine(chat_format.Template())
        for r in roles:
            m.step(r)
        return m.bad, m.valid

    assert run("system", "user", "assistant", "user") == (0, True)
    assert run("user", "assistant", "assistant") == (1, False)
    assert run("assistant", "user") == (1, False)  # an answer comes first; a question may follow it
    assert run("system") == (0, False) and run() == (0, False)
    assert run("user", "tool", "assistant") == (2, False)


def brute_chats(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss)))
    return plain(out)


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_conversations_equal_brute_force(spark, part):
    rng = random.Random(part)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([None, "", "".join(rng.choices(PIECES, k=9))])) for _ in range(300)]
    rows += [(4, 0, "user", "word " * 60_000), (4, 1, "assistant", "\\" * 300_000), *rows[:20], *chat_format.ADVERSE]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, part string, last int")
    got = chat_format.read_back(chat_format.format_conversations(df, part_chars=part)).collect()
    assert plain(r[:5] for r in got) == brute_chats(rows)
    again = chat_format.format_conversations(df, part_chars=part).repartition(7, "part").repartition(3, "conv_id").sortWithinPartitions("conv_id", "part")
    assert plain(chat_format.read_back(again).collect()) == plain(got)
    if part == 1:
        assert chat_format.format_conversations(df, part_chars=part).count() == len(rows)  # a turn is the least that a part holds


def test_chats_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(none)).count() == 0
    assert [r["conv_id"] for r in chat_format.chats(none).collect()] == [-1]


def test_only_answers_are_learned(spark):
    row = chat_format.format_conversations(spark.createDataFrame(chat_format.ADVERSE, "conv_id long, turn long, role string, text string")).first()
    assert [(s["text"], s["loss"]) for s in row["segments"]] == [("[INST] ", False), ("\\</s>\\[INST] ok \\[/INST]", False), (" [/INST]", False), ("<s>", False), ("\\</s>\\[INST] ok \\[/INST]", True), ("</s>", False)]
    assert row["last"] and row["valid"] and row["bad_turns"] == 0


# centroid clustering


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((digest(f"1:{i}"), v) for i, v in kept if i is not None)
    points = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, g in groups.items():
            points[c] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return plain((i, c, d, sum(e for _, e, b in found if b == c), total, digest(",".join(map(str, points[c])))) for i, d, c in found)


def vectors(n, seed, spread):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 64 for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "rounds", "spread"), [(300, 16, 3, 40), (300, 5, 2, 1), (10, 16, 3, 3), (120, 100, 1, 2)])
def test_clusters_equal_brute_force(spark, n, k, rounds, spread):
    rows = vectors(n, k, spread)
    rows += rows[:9] + [(1000 + i, rows[0][1]) for i in range(n // 3)]  # repeated rows and a hot vector
    rows += [(None, rows[1][1]), (2000, None), (2001, [1.0]), (2002, []), (2003, [float("nan")] * 64), (2004, [None] + [1.0] * 63), (2005, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, v string")
    assert plain(orchard.cluster(df, "vec_id", "embedding", k=k, rounds=rounds).collect()) == brute_clusters(rows, k, rounds)


def test_clusters_of_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [0.5])], "vec_id long, embedding array<float>")
    out = orchard.cluster(df, "vec_id", "embedding")
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = spark.createDataFrame([(1, [3e38] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in orchard.cluster(far, "vec_id", "embedding").collect()] == [2]  # beyond exact 64 bits


def test_search_takes_fewer_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (200, 64))
    x = np.repeat(centres, 20, axis=0) + rng.integers(-9, 9, (4000, 64))
    best, d, taken = orchard.Centroids(centres).nearest(x)
    full = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (d == full.min(1)).all() and taken < 0.75 * full.size


def test_ties_take_the_smaller_number():
    points = np.array([[4, 0], [0, 4], [0, 0], [4, 0]])
    best, d, _ = orchard.Centroids(points).nearest(np.array([[2, 2], [4, 0], [2, 0], [0, 2]]))
    assert best.tolist() == [0, 0, 0, 1] and d.tolist() == [8, 0, 4, 4]


# manifest


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def brute_tree(digests, fanout):
    steps, own, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, at in enumerate(own):
            first = at // fanout * fanout
            steps[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            own[i] = at // fanout
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], steps


def brute_manifest(rows, fanout=2):
    by = {}
    for doc_id, source, lang, n, text in rows:
        bad = n is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        by.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), digest(encoded(doc_id, source, lang, n, text)), digest(encoded(doc_id, source, lang, n + 1, text)) if bad else None, doc_id))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: r[:2])
        trees[lang] = brute_tree([r[1] for r in by[lang]], fanout)
    root, tops = brute_tree([trees[x][0] for x in langs], fanout)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (_, leaf, bad, doc_id), path in zip(by[lang], trees[lang][1], strict=True):
            x = bad or leaf
            for left, right in path + top:
                x = digest(left + x + right)
            out.append((doc_id, leaf, trees[lang][0], root, digest("".join(a + b for a, b in path + top)), x, x == root))
    return plain(out)


ROW = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 0), (2, 3), (3, 1), (5, 2)])
def test_manifest_equals_brute_force(spark, fanout, levels, monkeypatch):
    monkeypatch.setattr(manifest, "ROUNDS_A_PLAN", 3)
    rng = random.Random(fanout)
    rows = [(rng.choice([i, i, None, 7]), rng.choice(["s", "é", None]), rng.choice(["en", "en", "en", "de", "日本", "", None]), rng.choice([i, None]), rng.choice(["", None, f"text {i} é"])) for i in range(150)]
    rows += rows[:30] + [(5, "s", "en", 2**63 - 1, "long " * 60_000), (5, "s", "one", 1, "x")] + [(9, "s", "en", 1, "same")] * 40
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW + ", key string, digest int")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = lambda n: manifest.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    got = manifest.manifest(df, "doc_id", "lang", leaf(F.col("n_chars")), F.when(tampered, leaf(F.col("n_chars").cast("decimal(20,0)") + 1)), fanout, levels)
    assert plain(got.collect()) == brute_manifest(rows, fanout)
    if (fanout, levels) == (2, 12):
        assert plain(manifest.documents_manifest(df).collect()) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_smallest_manifests(spark, n):
    rows = [(i, "s", "en", 1, "x") for i in range(n)]
    assert plain(manifest.documents_manifest(spark.createDataFrame(rows, ROW)).collect()) == (brute_manifest(rows) if n else [])


def test_tampering_is_found(spark, small):
    out = manifest.documents_manifest(spark.read.parquet(f"{small}/documents.parquet"))
    bad = {r["doc_id"] for r in out.where("not verified").collect()}
    assert bad == {r["doc_id"] for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}


# media and archives


def test_a_program_without_its_table_is_skipped():
    from loamline.llm import mpegts

    payload = mpegts.padded(b"some text that is stored")
    media = bytearray(mpegts.mux(payload))
    whole = mpegts.demux(bytes(media))
    assert whole["broken_programs"] == [] and whole["payload"] == payload and whole["access_points"] == [(0, 0)]
    body = bytes([0, 9, 0xE0 | 0x1F, 0x55]) + bytes([0, 1, 0xE0 | media[188 + 1] & 0x1F, media[188 + 2]])  # program 9 has a PID that no packet has, program 1 its own
    section = b"\x00" + (0xB000 | 9 + len(body)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += mpegts.crc32_mpeg(section).to_bytes(4, "big")
    packet = b"\x47\x40\x00\x10\x00" + section
    media[:188] = packet + b"\xff" * (188 - len(packet))
    got = mpegts.demux(bytes(media))
    assert got["broken_programs"] == [9] and got["payload"] == payload and mpegts.feature_of(got).endswith("broken_programs=1")


def test_archives_are_read_as_streams(spark, tmp_path, monkeypatch):
    from loamline.llm import warc

    monkeypatch.setattr(warc, "BATCH_BYTES", 1000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'é' * 700 * i}</p>") for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.archived_pages(pages, segment=2048).collect()}
    assert got == {i: (7 + 1400 * i, "response") for i in range(12)}
    with pytest.raises(ValueError, match="short"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
