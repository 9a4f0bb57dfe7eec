import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard

from swathline.llm import warc
from swathline.llm.sharding import best_fit_decreasing, even_shards, shard_table
from tests.llm.fixtures import awkward_texts, repeated, table

PAGES = "page_id long, url string, html string, digest string, owner string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None, "y") for i, u, h in rows], PAGES)


def test_archives_round_trip(spark, tmp_path):
    long, other, short = "<p>é" * 400, "<i>" * 500, "short"
    rows = [(1, "http://a", long), (5, "http://b", long), (3, None, long), (2, "http://c\r\nX: y", short), (9, "u", short), (7, "v", None), (8, "w", "")]
    rows += [(20, "d", other), (20, "d", other), (19, "d", other), (None, "n", "no id " * 300), (None, "n", long), (30, "l", "x" * 3_000_000)]
    rows += [(100 + i, f"http://site/{i}", f"<html>{i} {'body ' * 200}</html>") for i in range(300)]
    archives = warc.write_archives(pages(spark, rows), str(tmp_path / "with a blank"))
    got = warc.read_archives(archives).collect()
    owner = defaultdict(int)
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            owner[html] = max(owner[html], i)
    want, have = Counter(), Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        own = owner.get(html) or None
        revisit = own is not None and own != i
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", own if revisit else None)] += 1
    for r in got:
        have[(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])] += 1
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert have == want
    assert {r["url"] for r in got if r["page_id"] == 2} == {"http://c%0D%0AX:%20y"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(records, dictionary=None, packed=True):
    out = b""
    if dictionary is not None:
        body = zstandard.ZstdCompressor().compress(dictionary.as_bytes()) if packed else dictionary.as_bytes()
        out += struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body
    compressor = zstandard.ZstdCompressor(dict_data=dictionary)
    return out + b"".join(compressor.compress(r) for r in records)


@pytest.mark.parametrize("packed", [True, False, None])
def test_leading_dictionary(packed):
    records = [warc.make_record(i, f"http://x/{i}", b"<html>page %d</html>" % i * 20, hashlib.sha1(b"<html>page %d</html>" % i * 20).hexdigest(), None) for i in range(200)]
    dictionary = None if packed is None else zstandard.train_dictionary(4096, records)
    data = archive(records, dictionary, bool(packed))
    assert list(warc.read_frames(io.BytesIO(data))) == records
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_frames(io.BytesIO(data[:-3])))
    assert list(warc.read_frames(io.BytesIO(b""))) == []


def test_bad_records_are_refused():
    payload = b"hello"
    good = warc.make_record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    assert warc.parse_record(good)["payload"] == payload
    for bad in (good[5:], good[:-1], good + b"x", good.replace(b"hello", b"hallo"), good.replace(b"WARC-Date", b"WARC-Type"), good.replace(b"WARC-Record-ID: <", b"Other: <"), good + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_best_fit_against_plain_search():
    rng = random.Random(2)
    for _ in range(150):
        sizes = Counter(rng.randrange(1, rng.choice([30, 3000])) for _ in range(rng.randrange(1, 150)))
        order = sorted(sizes.items(), reverse=True)
        capacity = max(sizes) + rng.randrange(4000)
        room, want = [], []
        for size, many in order:
            for _ in range(many):
                fits = [(r, i) for i, r in enumerate(room) if r >= size]
                i = min(fits)[1] if fits else len(room)
                if not fits:
                    room.append(capacity)
                room[i] -= size
                want.append((size, i))
        assert sorted((s, b) for s, b, n in best_fit_decreasing(order, capacity) for _ in range(n)) == sorted(want)
        placed = even_shards(order, 16)
        assert Counter({s: n for s, n in order}) == sum((Counter({s: n}) for s, _, n in placed), Counter())


def check_shards(df, texts):
    rows = df.collect()
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for shard, own in slots.items():
        assert 0 <= shard < 16 and sorted(own) == list(range(len(own)))
    if texts is not None:
        for r in rows:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
            homes[texts[r["doc_id"]]].add(r["shard"])
        assert all(len(h) == 1 for h in homes.values())
    return load


def test_shards(spark):
    texts = dict(enumerate(awkward_texts(), 10))
    check_shards(shard_table(table(spark)), texts)
    many = ["hot"] * 200 + [f"text {i} " * (i % 17 + 1) for i in range(1500)]
    load = check_shards(shard_table(table(spark, many)), dict(enumerate(many, 10)))
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 0.01 * max(load.values()) + 20
    check_shards(shard_table(repeated(spark)), None)
    assert shard_table(repeated(spark)).count() == 6
    assert shard_table(table(spark, [], [])).count() == 0
