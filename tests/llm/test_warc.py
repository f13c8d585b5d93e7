"""WARC archives (op 5): write and read back against digests made here."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

from wardlens.llm import warc_chunks


def test_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    long = "é" * 5000 + "\n\r\n" + "ñ" * 5001
    texts = ["<p>a</p>", tricky, "", None, "<p>a</p>", "line\n", "line\n\n", "\r\n\r\n", long, "x" * 4096, long, "x" * 4097, "é\n" * 3000]
    rows = [(k * 5 - 3, None if k == 2 else f"http://h/{k}\nx", t, "extra") for k, t in enumerate(texts)]
    rows += [(None, None, "<p>a</p>", None), (400, "u", "same", ""), (400, "u", "same", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    path = str(tmp_path / "warc")
    got = warc_chunks.round_trip(pages, path, chunk=1024).collect()
    first: dict[bytes, int] = {}
    for i, _, t, _ in rows:
        if i is not None:
            body = (t or "").encode()
            first[body] = min(i, first.get(body, i))
    want = []
    for i, _, t, _ in rows:
        body = (t or "").encode()
        other = None if i is None or first[body] == i else first[body]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other is not None else "response", other))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    chunks = warc_chunks.read_chunks(spark, path).where(f"record_id = '{8 * 5 - 3}'").orderBy("chunk_no").collect()
    assert b"".join(r["chunk"] for r in chunks) == long.encode() and len(chunks) == 20
    assert [r["n_bytes"] for r in chunks][:2] == [1024, 2048] and chunks[-1]["last"]
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in Path(path).glob("part-*"))
    assert warc_chunks.round_trip(pages.limit(0)).count() == 0
