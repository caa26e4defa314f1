import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from evidex.llm import shard, warc

ODD_PAGES = [
    (70001, "http://a", None),
    (70002, None, ""),
    (None, "http://b", "x" * 1500),
    (70003, "http://c\r\nX: y", "x" * 1500),
    (70004, "http://d", "x" * 1500),
    (70004, "http://d", "x" * 1500),
    (70005, "http://e", "small"),
    (70006, "http://e", "small"),
    (70007, "http://f", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 400),
    (70008, "http://g", "\r\n\r\n" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark, tables):
    odd = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    both = tables["pages"].select("page_id", "url", "html").union(odd)
    return both.selectExpr("*", "'mine' AS digest", "'mine' AS k", "'mine' AS n", "1 AS owner")


def expected(rows):
    data = [(p, (h or "").encode()) for p, h in rows]
    owner = {}
    for page, payload in data:
        if len(payload) >= 1000:
            key = hashlib.sha1(payload).hexdigest()
            owner[key] = max(owner.get(key, -1), -1 if page is None else page)
    out, used = [], set()
    for page, payload in data:
        digest = hashlib.sha1(payload).hexdigest()
        first = len(payload) < 1000 or (page == owner[digest] and digest not in used)
        if page == owner.get(digest):
            used.add(digest)
        out.append((page, len(payload), digest, "response" if first else "revisit", None if first else owner[digest]))
    return out


def test_round_trip_matches_brute_force(pages, tmp_path):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert Counter(map(tuple, got)) == Counter(expected(rows))


def test_records_are_whole_and_concurrent(pages, spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = [r for f in Path(path).glob("*.gz") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    kinds = Counter(h["WARC-Type"] for h, _ in records)
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == pages.count()
    ids = {h["WARC-Record-ID"] for h, _ in records}
    assert len(ids) == len(records)
    assert all(h["WARC-Concurrent-To"] in ids for h, _ in records if h["WARC-Type"] in ("request", "metadata"))
    assert all(h["WARC-Refers-To"] in ids for h, _ in records if h["WARC-Type"] == "revisit")
    whole = warc.assemble(warc.read_records(spark, path))
    assert whole.filter("request is null or metadata is null").count() == 0
    payloads = {r.metadata.page_id: bytes(r.response.payload) for r in whole.filter("response.record_type = 'response'").collect()}
    assert payloads[70007] == (ODD_PAGES[8][2]).encode() and payloads[70008] == b"\r\n\r\n" * 300_000


def test_no_pages(pages, tmp_path):
    assert warc.round_trip(pages.filter("false"), str(tmp_path / "w")).count() == 0


def test_damage_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.parse(record * 2))[1][1] == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse(record + b"rest\r\n\r\n"))


def plain_table(names, slots):
    """The filling as described: turn by turn, from written-out preference lists."""
    order = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        order.append([(offset + j * skip) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for i, own in enumerate(order):
            free = next((s for s in own if s not in table), None)
            if free is not None:
                table[free] = i
    return [table[s] for s in range(slots)]


def test_table_filling():
    names = [f"s{i}" for i in range(7)]
    table = shard.fill_table(names, 251)
    assert table == plain_table(names, 251)
    load = Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = shard.fill_table(names[:-1], 251)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 251 * 0.25  # few slots of other shards change hands
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shard.fill_table(bad, 251)
    with pytest.raises(ValueError):
        shard.fill_table(names, 250)


def test_placement_matches_brute_force(mixed):
    placed = shard.place(mixed)
    assert placed.columns == [c for c in mixed.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    names = [f"shard-{i:05d}" for i in range(shard.SHARDS)]
    table = shard.fill_table(names)
    got = placed.select("doc_id", "slot", "shard").collect()
    assert len(got) == mixed.count()
    for r in got:
        text = "null" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % shard.SLOTS
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert shard.place(mixed.filter("false")).count() == 0
