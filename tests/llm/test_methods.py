"""The corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.llm import chunk_dedup, components, minhash, mixing, mpegts, packing, quality, site_style, toxicity, warc
from loamline.llm.common import written
from loamline.llm.textbytes import shingle_hashes, text_bytes, word_bounds, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# words and sets


def test_word_hashes():
    texts = ["", None, "a A b", "a  b\ta\n", "né É", "a", "x" * 70_000 + " a"]
    raw, offsets = text_bytes(pa.array(texts))
    starts, ends, first = word_bounds(raw, offsets)
    words = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat, by = [x for w in words for x in w], collections.defaultdict(set)
    for w, h in zip(flat, word_hashes(raw, starts, ends).tolist(), strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_slices_hash_alike():
    texts = pa.array(["zero", "one two three four", "", "five"])
    h, first = shingle_hashes(*_words(texts), 3)
    part = texts.slice(1, 2)
    g, f = shingle_hashes(*_words(part), 3)
    assert h[first[1] : first[3]].tolist() == g.tolist() and np.diff(first).tolist() == [1, 2, 0, 1] and np.diff(f).tolist() == [2, 0]


def _words(texts):
    raw, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends), first


# near duplicates


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed=3, groups=6, size=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, width, percent, monkeypatch):
    monkeypatch.setattr(minhash.candidate_groups, "__defaults__", (12,))  # branch, deal and compare across on small data
    monkeypatch.setattr(minhash, "GROUP_ROWS", 10)
    rows = [(100_000 + i, t) for i, t in planted()] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_exact_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300, replace=False), rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in rng.integers(0, 60, 70)] + [base[:5], base[:5]]
    i, j = minhash.exact_pairs(np.concatenate([np.sort(s) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 60)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 10


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(50)] + [(7, 5000 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    label = components.labels(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert all(got.get(x, x) == nodes[label[k]] for k, x in enumerate(nodes))


# packing


def test_packing_places_every_token_once(spark, docs):
    from tokenizers import Tokenizer

    rows = docs.unionByName(docs.limit(20).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.repeat(F.concat("text", F.lit(" ")), 40)}))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(rows).collect():
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))
        ]
    total = 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(used) <= math.ceil(total / 4096) * 1.01 + 1


def test_word_encoder_on_odd_words():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", None, "a<|endoftext|>b <|STARTOFTEXT|>", "x́ ́y Z's don't 12 \x85q\x1cz", "ΑΣ Σ, İstanbul. ǅ ﬁ ÅÅ", " \n", "WORD.,!? W.O.R.D ½² 日本 \U0001f600!", "isn't, we'll."] * 2
    ids, offsets = packing.WordEncoder(packing.default_tokenizer()).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_plan_is_whole_and_tight():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6.5, 1, 20_000).astype(int) + 1, 4096)
    histogram = collections.Counter(lengths.tolist())
    runs, sequences = packing.plan_packing(dict(histogram))
    placed, room = collections.Counter(), np.zeros(sequences, int)
    ranks = collections.defaultdict(list)
    for length, rank, count, first, _ in runs:
        placed[length] += count
        room[first : first + count] += length
        ranks[length].append((rank, count))
    assert placed == histogram and room.max() <= 4096 and sequences <= math.ceil(lengths.sum() / 4096) * 1.005 + 1
    assert all(sorted(r)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(r), sorted(r)[1:], strict=False)) for r in ranks.values())


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(0, rng.normal(size=12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=30)
    got = packing.nnls(a, b)
    gradient = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gradient <= 1e-6).all() and np.allclose(gradient[got > 0], 0, atol=1e-6)


# mixing


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, None: 1000, "c": 50})
    assert t["b"] == 30 and sum(t.values()) == pytest.approx(1160) and t["a"] == 300 and t["c"] == pytest.approx(830 / 6) and t[None] == pytest.approx(830 * 5 / 6)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mix_follows_the_keys(docs):
    rows = mixing.mix_sources(docs).collect()
    keys = {r["doc_id"]: (r["source"], r["size"], r["key"]) for r in mixing.measured(docs).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == keys[r["doc_id"]][1]
        by[keys[r["doc_id"]][0]].append(r)
    for own in by.values():
        goal, size = math.floor(own[0]["target"] + 0.5), own[0]["source_size"]
        assert sum(r["size"] for r in own) == size and sum(r["taken"] for r in own) == goal
        epochs, left = min(3, goal // size), goal - min(3, goal // size) * size
        for r in sorted(own, key=lambda r: (keys[r["doc_id"]][2], r["doc_id"])):  # the sample is the smallest keys
            extra = max(0, min(r["size"], left))
            assert r["taken"] == epochs * r["size"] + extra
            left -= r["size"]
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(7)).collect())


# media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 161, 162, 176, 345, 346, 8000, 8001, 100_003])
def test_transport_stream_round_trip(n):
    payload = mpegts.padded(random.Random(n).randbytes(n))
    stream = mpegts.mux(payload)
    got = mpegts.demux(stream)
    assert got["payload"] == payload and got["continuity_errors"] == 0 and len(stream) % 188 == 0
    assert got["access_points"] == [(k * 90_000, k * 8000) for k in range(-(-len(payload) // 8000))]
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert mpegts.demux(b"".join(p for q in packets for p in (q, q)))["payload"] == payload  # repeated packets are dropped
    if len(packets) > 60:
        assert mpegts.demux(b"".join(packets[:30] + packets[31:]))["continuity_errors"] == 1
    with pytest.raises(ValueError):
        mpegts.demux(b"\x00" + stream[1:])


def packet_of(pid, counter, data, start=False, flags=None):
    """One transport packet; an adaptation field takes up what data leaves."""
    head = b"\x47" + ((0x4000 if start else 0) | pid).to_bytes(2, "big")
    room = 184 - len(data)
    if flags is None and not room:
        return head + bytes([0x10 | counter & 15]) + data
    return head + bytes([0x30 | counter & 15, room - 1]) + (bytes([flags or 0]) + b"\xff" * (room - 2) if room > 1 else b"") + data


def other_stream():
    """What another writer may send: two programs, a map table over two packets, no random access flags, an announced discontinuity, a network entry."""
    section = mpegts._section(0, b"\x00\x01\xc1\x00\x00" + b"\x00\x00\xe0\x10" + b"\x00\x01\xe1\x00" + b"\x00\x02\xe2\x00")
    out = [packet_of(0, 0, (b"\x00" + section).ljust(184, b"\xff"), start=True)]
    for number, pid, stream, text in ((1, 0x100, 0x101, b""), (2, 0x200, 0x201, b"d" * 230)):
        info = b"\x83" + bytes([len(text)]) + text if text else b""
        long = mpegts._section(2, number.to_bytes(2, "big") + b"\xc1\x00\x00" + (0xE000 | stream).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | stream).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info)
        data = b"\x00" + long
        out += [packet_of(pid, k, data[a : a + 184].ljust(184, b"\xff"), start=k == 0) for k, a in enumerate(range(0, len(data), 184))]
    for stream, body in ((0x101, b"first"), (0x201, b"second")):
        unit = b"\x00\x00\x01\xbd" + (len(body) + 3).to_bytes(2, "big") + b"\x80\x00\x00" + body
        out += [packet_of(stream, 3, unit, start=True), packet_of(stream, 9, unit, start=True, flags=0x80), packet_of(stream, 12, unit, start=True)]
    return b"".join(out)


def test_streams_of_other_writers(spark):
    stream = other_stream()
    got = mpegts.demux(stream)
    assert (got["payload"], got["continuity_errors"], got["access_points"], got["times"]) == (b"first" * 3, 1, [], [])
    assert mpegts.demux(stream, program=2)["payload"] == mpegts.demux(stream, stream_pid=0x201)["payload"] == b"second" * 3
    with pytest.raises(ValueError, match="no such"):
        mpegts.demux(stream, program=3)
    rows = spark.createDataFrame([(1, 15, bytearray(stream))], "doc_id long, n_bytes long, media binary")
    assert "access_points=0 pts=none" in mpegts.demux_streams(rows).first()["feature"]


def test_media_query(spark, docs, small):
    from loamline.llm import registry

    out = {r["doc_id"]: r for r in registry.op6_transport_streams(spark, small).collect()}
    for r in docs.collect():
        raw = r["text"].encode()
        payload = mpegts.padded(raw)
        media = mpegts.mux(payload)
        got = out[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got["media_bytes"], got["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        units = -(-len(payload) // 8000)
        # by the format: two tables, and a unit of n bytes with its 14 of head takes 176 bytes of its first packet and 184 of each more
        packets = 2 + sum(1 + -(-max(0, min(8000, len(payload) - 8000 * k) + 14 - 176) // 184) for k in range(units))
        assert got["feature"] == f"mpegts type=6 packets={packets} units={units} continuity_errors=0 access_points={units} pts=0..{(units - 1) * 90000} mean={sum(payload) / len(payload):.3f}"


# archives


def test_records_and_segments():
    page = "é<p>" * 9000 + "\r\n\r\nWARC/1.1\r\n"
    data = "".join(r + "\r\n\r\n" for r in warc.page_records(5, "http://x/\r\ny", page, None, 10_000)).encode()
    found = list(warc.parse(data))
    assert len(found) > 3 and [f["warc-type"] for f, _ in found] == ["response"] + ["continuation"] * (len(found) - 1)
    block = b"".join(b for _, b in found)
    assert warc.http_payload(block) == page.encode() and int(found[-1][0]["warc-segment-total-length"]) == len(block)
    assert found[0][0]["warc-target-uri"] == "http://x/y" and {f["warc-segment-origin-id"] for f, _ in found[1:]} == {found[0][0]["warc-record-id"]}
    with pytest.raises(ValueError, match="chunk"):
        warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n")


def test_missing_segment_is_found(spark):
    rows = [("<o>", 1, "response", 1, None, None, None, None, b"HTTP/1.1 200 OK\r\n\r\nab"), ("<o>", 3, "continuation", None, None, None, None, 30, b"cd")]
    with pytest.raises(Exception, match="segments"):
        warc.reassemble(spark.createDataFrame(rows, warc._FIELDS)).collect()


def test_archives_round_trip(spark, small):
    import base64

    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(pages.limit(9).withColumn("page_id", F.col("page_id") + 5000))
    rows = pages.collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"], r["page_id"])
    want = sorted(
        (r["page_id"], len(r["html"].encode()), base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode(), "response" if first[r["html"]] == r["page_id"] else "revisit", None if first[r["html"]] == r["page_id"] else first[r["html"]])
        for r in rows
    )
    assert sorted(map(tuple, warc.archived_pages(pages, segment=1500).collect()), key=lambda r: r[0]) == want


# pages

FURNISHED = """<!doctype html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body><header class="top"><h1>Site</h1></header><div id="cookie-notice">We use</div>
<div class="menu"><ul><li>a<li>b</ul></div><main><h1>T&eacute;st &amp; co</h1><p>One<br>two <b>bo</b>ld <script>if (a < b) "</p>"</script>text<p>three<ul><li>i1<li>i2 <em>e</em></ul>
<table><tr><td>c1<td>c2</table><form><input>f</form><div class="comments"><p>reader</div><aside>side</aside><blockquote>q</blockquote>tail &lt;x&gt; 1 < 2<!-- no --></main><footer>f</footer></body></html>"""


def plain_text(page, low=frozenset()):
    """The text by the rules of the markup and a set of removed paths, without Spark."""
    blocks = [b for b in site_style.parse(page)[0] if b.dropped == site_style.READ and b.text()]
    framed = any(b.article for b in blocks)
    return "\n\n".join(b.text() for b in blocks if (b.article or not framed) and not (b.path in low and (not b.article or b.named)))


def test_main_text():
    assert plain_text(FURNISHED).split("\n\n") == ["Tést & co", "One two bold text", "three", "i1", "i2 e", "c1", "c2", "q", "tail <x> 1 < 2"]
    assert plain_text("") == "" and plain_text("plain &amp text") == "plain & text"
    assert plain_text("<b>" * 20_000 + "deep") == "deep"


def brute_tree(pages):
    """path -> (pages, content) of one host's pages, by counting texts page by page; equal pages count once."""
    held, seen = collections.defaultdict(lambda: collections.defaultdict(set)), set()
    for i, html in enumerate(pages):
        blocks = [b for b in site_style.parse(html)[0] if b.dropped != site_style.UNREAD and b.text()]
        key = tuple(sorted((b.path, b.text()) for b in blocks))
        if key in seen:
            continue
        seen.add(key)
        for b in blocks:
            for x in site_style.PARTS.split(b.text()):
                if x:
                    held[b.path][x].add(i)
    out = {}
    for path, sentences in held.items():
        m = len(set().union(*sentences.values()))
        out[path] = (m, 1.0 if m < 2 else sum(1 - math.log(len(s)) / math.log(m) for s in sentences.values()) / len(sentences))
    return out


def test_style_tree_equals_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages = pages.unionByName(pages.limit(30).withColumn("page_id", F.col("page_id") + 5000))
    tree, whole = site_style.style_tree(written(site_style.page_blocks(pages), "blocks"))
    by = collections.defaultdict(list)
    for r in pages.collect():
        by[site_style.digest(site_style.host_of(r["url"]))].append(r["html"])
    got = {(r["host"], r["path"]): (r["pages"], pytest.approx(r["content"])) for r in tree.collect()}
    assert {(h, p): v for h, own in by.items() for p, v in brute_tree(own).items()} == got
    assert {r["path"]: (r["pages"], pytest.approx(r["content"])) for r in whole.collect()} == brute_tree([h for own in by.values() for h in own])


def test_style_tree_finds_what_repeats(spark):
    pages = [(i, f"http://h{i % 2}.x/{i}", f"<div class=a><p>Story {i} told</p></div><div class=b>Follow us</div><div class=c>Part {i % 2}</div>", 0) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    tree, whole = site_style.style_tree(written(site_style.page_blocks(df), "blocks"))
    own, every = ({r["path"]: r for r in t.collect()} for t in (tree.where(F.col("host") == site_style.digest("h0.x")), whole))
    at = site_style.path_key
    assert own[at("/div.a/p")]["content"] == 1 and own[at("/div.b")]["content"] == pytest.approx(0) and own[at("/div.b")]["pages"] == 20
    assert every[at("/div.c")]["content"] == pytest.approx(1 - math.log(20) / math.log(40))
    out = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    assert out == {i: f"Story {i} told" for i in range(40)}


NEUTRAL = (("<nav>", "<div class='xa'>"), ("</nav>", "</div>"), ('class="ad"', "class='xb'"), ("<footer>", "<div class='xc'>"), ("</footer>", "</div>"), ("<article>", "<div class='xd'>"), ("</article>", "</div>"))


def test_the_tree_decides_where_markup_is_silent(spark, monkeypatch):
    """Generic elements with names of the site's own: the tree alone gives the text that telling markup gives; without it furniture stays."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = F.col("html")
    for telling, silent in NEUTRAL:
        html = F.replace(html, F.lit(telling), F.lit(silent))
    told = {r["page_id"]: plain_text(r["html"]) for r in pages.collect()}
    silent = pages.withColumn("html", html)
    assert {r["page_id"]: r["text"] for r in site_style.extract(silent).collect()} == told
    monkeypatch.setattr(site_style, "low_paths", lambda tree, whole: tree.select("host", "path", F.lit(False).alias("inside")).limit(0))
    without = {r["page_id"]: r["text"] for r in site_style.extract(silent).collect()}
    assert all(len(without[i]) > len(t) for i, t in told.items())


def test_style_tree_without_broadcast(spark, monkeypatch):
    pages = [(i, "http://h.x/" if i < 12 else f"http://o{i}.x", f"<p>Story {i}</p><div class=b>Follow us</div>", 0) for i in range(15)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n int")
    monkeypatch.setattr(site_style, "small_enough", lambda *a: False)
    assert {r["page_id"]: r["text"] for r in site_style.extract(df).collect()} == {i: f"Story {i}" for i in range(15)}


@pytest.mark.parametrize("frame", ["<p class=t>{}</p>", "<article><p class=t>{}</p></article>"])
def test_copies_of_a_page_are_no_furniture(spark, frame):
    """A host of copies, one that is mostly copies, and copies on many hosts keep their text."""
    texts = [("same.x", "only page")] * 6 + [("most.x", "page again")] * 30 + [("most.x", f"page {i}") for i in range(6)] + [(f"h{i}.x", "mirrored") for i in range(40)]
    pages = [(i, f"http://{host}/{i}", frame.format(text)) for i, (host, text) in enumerate(texts)]
    out = site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: text for i, (_, text) in enumerate(texts)}


REPEATS = '<article><h2 class="t">Methods</h2><p class="c">Story {0} of this page</p><p class="c">We thank our readers.</p><table><tr><td class="k">Size<td class="k">{0} cm</table><ul class="l"><li>Always</li><li>item {0}</li></ul><div class="xk">Follow us</div><p>The law is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, {0}</p></article>'


@pytest.mark.parametrize("n", [1, 4, 8, 40])
def test_article_text_stays_however_often_it_repeats(spark, monkeypatch, n):
    """Headings, paragraphs, table cells and list items of articles are never furniture; the tree alone removes a repeated element of the site's own, which without it stays."""
    pages = spark.createDataFrame([(i, f"http://h.x/{i}", REPEATS.format(i)) for i in range(n)] + [(1000 + i, f"http://o{i}.y/", f"<p>else {i}") for i in range(9)], "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in site_style.extract(pages.where("page_id < 1000")).collect()}
    want = lambda i, more: "\n\n".join(["Methods", f"Story {i} of this page", "We thank our readers.", "Size", f"{i} cm", "Always", f"item {i}", *more, f"The law is E=m here, {i}"])
    assert texts() == {i: want(i, ["Follow us"] if n == 1 else []) for i in range(n)}
    monkeypatch.setattr(site_style, "low_paths", lambda tree, whole: tree.select("host", "path", F.lit(False).alias("inside")).limit(0))
    assert texts() == {i: want(i, ["Follow us"]) for i in range(n)}


# chunks


def test_gear_hash_and_shift():
    words, first = _words(pa.array(["abc def " * 40, "xyzzy " * 30, "", "one two"]))
    h = chunk_dedup.gear_hashes(words, first)
    for d in range(4):
        for i in range(first[d], first[d + 1]):
            assert int(h[i]) == sum(int(words[i - k]) << 8 * k for k in range(8) if i - k >= first[d]) & (1 << 64) - 1
    text = " ".join(f"tok{i * 7919 % 1009}é" for i in range(400))
    for insert in ("x ", "some words before ", "é " * 33):
        c = chunk_dedup.Cut(pa.array([text, insert + text]), 50)
        data = c.raw.tobytes()
        parts = [[data[c.starts[a] : c.ends[b - 1]] for a, b, d in zip(c.low, c.high, c.doc, strict=True) if d == k] for k in (0, 1)]
        assert [b" ".join(p).decode() for p in parts] == [text, (insert + text)]
        assert len(set(parts[0]) & set(parts[1])) >= 0.9 * len(parts[0]) and max(c.high - c.low) <= 21 + 7


def test_any_run_of_min_words_holds_a_common_chunk():
    rng = random.Random(8)
    for _ in range(60):
        run = [rng.choice("abc") if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(50)]
        texts = [" ".join(f"{k}{rng.randrange(99)}" for _ in range(rng.randrange(60))) + " " + " ".join(run) + " " + " ".join(f"{k}{rng.randrange(99)}" for _ in range(rng.randrange(60))) for k in "pq"]
        c = chunk_dedup.Cut(pa.array(texts), 50)
        digests = c.digest(c.low, c.high)
        assert set(digests[c.doc == 0]) & set(digests[c.doc == 1])


def brute_repeats(texts, n):
    """Documents with a run of n words that another document has too, and which words of each are copies of an earlier document's."""
    holders = collections.defaultdict(set)
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add(i)
    found, copies = set(), {i: set() for i in texts}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            own = holders[tuple(w[k : k + n])]
            if len(own) > 1:
                found.add(i)
                if min(own) < i:
                    copies[i] |= set(range(k, k + n))
    return found, copies


def test_repeats_equal_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n, rows in ((50, texts), (12, {i: " ".join((t or "").split()[:80]) for i, t in texts.items()})):
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
        spans = chunk_dedup.repeated_spans(df, n).collect()
        found, copies = brute_repeats(rows, n)
        assert {r["doc_id"] for r in spans} == found and found
        for r in spans:
            span = rows[r["doc_id"]].encode()[r["start"] : r["start"] + r["size"]].decode()
            before = len(WORD.findall(rows[r["doc_id"]].encode()[: r["start"]].decode()))
            assert len(WORD.findall(span)) == r["n_words"]
            if not r["kept"]:  # cut at chunks or words, never beyond what an earlier document has
                assert set(range(before, before + r["n_words"])) <= copies[r["doc_id"]] and r["first_doc_id"] < r["doc_id"]


def test_every_passage_survives_once(spark):
    x, y, z = (" ".join(_words_of(70 + k, 90)) for k in range(3))
    docs = spark.createDataFrame([(1, f"{x} {y}", 1), (2, f"{x} {y} {z}", 2), (3, f"{y} {z}", 3)], "doc_id long, text string, _cuts int")
    left = chunk_dedup.without_repeats(docs, chunk_dedup.repeated_spans(docs))
    assert left.columns == ["doc_id", "text", "_cuts"] and {(r["doc_id"], r["_cuts"]) for r in left.collect()} == {(1, 1), (2, 2), (3, 3)}
    words = collections.Counter(w for r in left.collect() for w in WORD.findall(r["text"]))
    every = set(f"{x} {y} {z}".split())
    assert set(words) == every and sum(words.values()) < 1.4 * sum(collections.Counter(f"{x} {y} {z}".split()).values())


def test_periodic_texts(spark):
    rows = {1: "a " * 300, 2: "b " + "a " * 60, 3: "a b " * 40, 4: "x a b " + "a b " * 30, 5: "c " * 49, 6: "c " * 49}
    spans = chunk_dedup.repeated_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in spans} == brute_repeats(rows, 50)[0] == {1, 2, 3, 4}


def _words_of(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(1000)}" for _ in range(n)]


def test_short_passage_with_common_edges_is_found(spark):
    """Every chunk of a passage of 52 words stands in documents 1 and 99 too, but only 10 and 20 share the passage."""
    for seed in range(2):
        passage = _words_of(seed, 52)
        text = " ".join(passage)
        common = [" ".join(passage[:26]), " ".join(passage[26:])]
        rows = [(k, f"{' '.join(_words_of(100 * seed + k, 30))} {x} {' '.join(_words_of(100 * seed + k + 1, 30))}") for k, x in ((10, text), (20, text), (1, common[0]), (2, common[1]), (98, common[0]), (99, common[1]))]
        spans = chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        texts = {i: t.encode() for i, t in rows}
        assert {(r["doc_id"], r["first_doc_id"], texts[r["doc_id"]][r["start"] : r["start"] + r["size"]].decode()) for r in spans} == {(10, 10, text), (20, 10, text)}


def test_chunks_of_different_documents_are_no_passage(spark):
    """All chunks of document 1 stand in other documents, none of which shares more than 30 words with it."""
    words = _words_of(1, 210)
    rows = [(1, " ".join(words)), *((10 + k, f"{' '.join(_words_of(50 + k, 40))} {' '.join(words[15 * k : 15 * k + 30])} {' '.join(_words_of(90 + k, 40))}") for k in range(13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert chunk_dedup.repeated_spans(docs).collect() == []


# classifiers


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x @ np.array([2.0, -1, 0, 0]) + rng.normal(size=600) * 0.3 > -1).astype(int)
    model = quality.BradleyTerry.fit(x, y)
    score = model.score(x)
    assert ((score >= 0.7) == y).mean() > 0.93 and abs((score < 0.7).mean() - (y == 0).mean()) < 0.01


def test_toxicity_on_held_out(spark):
    folder = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_grammar_tells_matches_apart():
    lexicon = toxicity.Lexicon({}, {"lowei": 1.0})
    kind = lambda t: {n for n, v in zip(toxicity.MATCHES, lexicon.matches(t), strict=False) if v > 0}
    assert kind("What an idiot.") == {"insult"} and kind("You are an idiot.") == {"targeted_insult"} and kind("idiot, you!") == {"targeted_insult"}
    assert kind("He is not an idiot.") == {"negated_insult"} and kind("She said the clown left") == {"reported_insult"} and kind("Not. An idiot.") == {"insult"}
    assert kind("I will kill time") == set() and kind("I will kill you") == {"targeted_threat"} and kind("I will not kill any of you") == {"negated_threat"} and kind('"I will kill you", it read') == {"reported_threat"}
    assert kind("loweischaft") == {"insult"} and kind("a clean text") == set() and kind("the trash can is full") == set() and kind("we feed clown fish") == set()
    weight = lambda t: lexicon.matches(t)[0]
    assert weight("utter idiot") > weight("idiot") and weight("a stupid clown") > weight("stupid. clown")
    assert lexicon.matches("I will hurt you")[5] > lexicon.matches("those who hurt you")[5] > 0
    model = toxicity.Model(lexicon, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    assert model.score("You are an idiot") > model.score("an idiot") > 0.5 > model.score("not an idiot") > model.score("hello")


#: Toxic and clean with the same words: only their order differs.
PAIRS = (
    ("you are an idiot and not clever", "you are not an idiot and clever"), ("that idiot said she left", "she said that idiot left"), ("I will hurt you", "you will I hurt"),
    ("not now I think I will kill you", "now I think I will not kill you"), ("we can trash you", "you we trash can"), ("you scum I never wrote", "I never wrote you scum"),
)


def test_order_decides_where_words_are_equal():
    lexicon = toxicity.Lexicon({}, {})
    model = toxicity.Model(lexicon, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    flat = lambda t: sum(lexicon.symbol(w)[0] in toxicity.HARSH for w in t.lower().split())
    for toxic, clean in PAIRS:
        assert sorted(toxic.split()) == sorted(clean.split()) and flat(toxic) == flat(clean) > 0  # a list of words can't tell them apart
        assert model.score(toxic) > 0.5 > model.score(clean), (toxic, clean)


SENTENCES = {
    "insult": """You are an idiot|what a pathetic excuse you are|shut up, moron|he is a complete loser|you worthless scum|their plan was written by a clown, a real clown|stupid fool, go away|such a disgusting vermin|you absolute imbecile|they are garbage and you know it|nobody likes you, loser|she is dumb and so are you""",
    "threat": """I will kill you|we are going to hurt you badly|he must strangle her|I shall hunt you down|we will smash your face|kill them all|they want to burn you|you will see, I will destroy you""",
    "not_just": """You are not just an idiot|he is not only a loser|you are not merely stupid, you are a moron""",
    "after_comma": """I never said you are smart, idiot|nobody said it was easy, moron|he told us about the trip, you clown""",
    "negated": """You are not an idiot|she is never stupid|they are no losers|I would never hurt you|we do not kill them""",
    "reported": """she said he is an idiot|he wrote that we are scum|the judge quoted "you are a loser" from the letter|they claimed I will kill you|according to him you are stupid""",
    "harmless": """the trash can is full|take out the trash|we sort the garbage on Monday|the clown fish lives in the reef|a garbage truck came by|I will beat you at chess|she will destroy him in tennis|he emptied the trash today|foul smells from garbage bags""",
    "lookalike": """the path is worth walking|it is worth the trip|we walked the path to the harbour|paths cross here|a worthy cause|the cloak is warm|disguise parties are fun|a stuffed bear|the mortar is dry""",
}


def test_sentences_by_kind(spark):
    """The model trained at sf0.1, whose labelled texts hold no grammar: the machines carry what the labels cannot teach, and a grammar of insults alone does clearly worse."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    right = {}
    for kind, text in SENTENCES.items():
        wanted = kind in ("insult", "threat", "not_just", "after_comma")
        scores = {t: model.score(t) for t in text.split("|")}
        right[kind] = sum((v >= 0.5) == wanted for v in scores.values()) / len(scores)
    assert all(v >= 0.85 for v in right.values()), right
    flat = lambda t: any(model.lexicon.symbol(w)[0] in toxicity.HARSH for w in re.findall(r"[^\W\d_]+", t.lower()))
    plain = {kind: sum(flat(t) == (kind in ("insult", "threat", "not_just", "after_comma")) for t in text.split("|")) / len(text.split("|")) for kind, text in SENTENCES.items()}
    assert plain["negated"] == plain["reported"] == 0 and plain["harmless"] < 0.2


def test_stems_need_several_words(spark):
    toxic = [(i, f"abc wxyz{w} {'pathetic' if i % 2 else ''} tail{i % 3}") for i, w in enumerate(["one", "two", "three", "four"] * 15)]
    clean = [(100 + i, f"abc quiet tail{i % 3} words here {i}") for i in range(400)]
    sample = spark.createDataFrame([(1, t) for _, t in toxic] + [(0, t) for _, t in clean], "label int, text string")
    lexicon = toxicity.learn_lexicon(sample)
    assert "wxyz" in lexicon.stems and not any("pathetic".startswith(s) for s in lexicon.stems)


def test_composition_equals_rewriting_one_after_another():
    rng = random.Random(5)
    machines = (toxicity.negation, toxicity.report, toxicity.threat, toxicity.insult, toxicity.target)
    for _ in range(400):
        symbols = [rng.choice([*range(10), *range(13, 18)]) for _ in range(rng.randrange(1, 14))]
        tape, weights = list(symbols), [1.0] * len(symbols)
        for machine in machines:
            state = 0
            for k, x in enumerate(tape):
                state, tape[k], w = machine(state, x)
                weights[k] *= w
        state, got = toxicity.GRAMMAR.start, []
        for x in symbols:
            state, out, w = toxicity.GRAMMAR.step(state, x)
            got.append((out, pytest.approx(w)))
        assert list(zip(tape, weights, strict=True)) == got


def test_one_row_a_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"t{k}") for k in range(50)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in quality.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect())
    assert got == [(1, 1, "t0"), (2, 0, "b"), (3, 1, None)]


def test_quality_features_equal_plain_counts(docs):
    texts = [r["text"] for r in docs.collect()] + ["", None, "a", "A A a\n\nA A a\n!", "é1 | é1"]
    got = quality.features(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        raw, words = (text or "").encode(), [w.encode() for w in WORD.findall(text or "")]
        n, size = max(1, len(words)), max(1, len(raw))
        share = lambda kinds: sum(c in kinds for c in raw) / size
        low = [w.lower() for w in words]  # bytes: A-Z only
        lines = [tuple(x.split()) for x in re.split(rb"\n", b"\n".join(raw.lower().split(b"\n")))]
        lines = [x for x in ([w for w in re.findall(rb"[^\x20\x09-\x0D]+", x.lower())] for x in raw.split(b"\n")) if x]
        seen, again = set(), 0
        for x in lines:
            key = tuple(sorted(x))  # a line's hash is the sum of its words'
            again += key in seen
            seen.add(key)
        want = {
            "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n / 10, "log_lines": math.log1p(raw.count(b"\n") + (len(raw) > 0)), "upper": share(range(65, 91)), "digits": share(range(48, 58)),
            "symbols": share(b"#$%&*+/<=>@[\\]^_`{|}~"), "commas": share(b","), "ends": share(b".!?"), "high": share(range(128, 256)), "repeats": sum(a == b for a, b in zip(low, low[1:])) / n,
            "repeats2": sum(a == b for a, b in zip(low, low[2:])) / n, "distinct": len(set(low)) / n, "top_word": max(collections.Counter(low).values(), default=0) / n, "long_words": sum(len(w) > 15 for w in words) / n,
            "repeated_lines": again / max(1, len(lines)),
        }
        for name, value in want.items():
            assert row[quality.NAMES.index(name)] == pytest.approx(value), (name, text)


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"] and pipeline.ORACLE_SQL is None
    documents = spark.read.parquet(f"{small}/documents.parquet")
    df, seen = documents, [documents.count()]
    for _, stage in pipeline.STAGES[:3]:
        df = stage(spark, df, small)
        assert df.columns == documents.columns
        df = spark.createDataFrame(df.collect(), documents.schema)
        seen.append(df.count())
    assert seen == sorted(seen, reverse=True) and df.select("text").distinct().count() == seen[3]
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert len({c for _, c in brute_components(rows, 5, 80).values()}) == seen[3]
    out = pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
