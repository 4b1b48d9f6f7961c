import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from corpusloom.llm import jpeg as j
from corpusloom.llm import queries as q


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value, f"0{n}b") if n else ""

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""


def encoded(block, before, bits):
    """One block the plain way, with the module's tables."""

    def value(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    n, v = value(block[0] - before)
    bits.put(int(j.DC_TABLE[2][n]), int(j.DC_TABLE[3][n]))
    bits.put(v, n)
    run = 0
    last = max((i for i in range(64) if block[i]), default=0)
    for i in range(1, last + 1):
        if not block[i]:
            run += 1
            continue
        while run > 15:
            bits.put(int(j.AC_TABLE[2][0xF0]), int(j.AC_TABLE[3][0xF0]))
            run -= 16
        n, v = value(block[i])
        bits.put(int(j.AC_TABLE[2][run << 4 | n]), int(j.AC_TABLE[3][run << 4 | n]))
        bits.put(v, n)
        run = 0
    if last < 63:
        bits.put(int(j.AC_TABLE[2][0]), int(j.AC_TABLE[3][0]))


def random_block(rng, density):
    return [rng.randint(-120, 120) if rng.random() < density else 0 for _ in range(64)]


def picture(rng, width, height, sampling, restart, density, quantiser=3):
    """(file, blocks by component in scan order) of an image made the plain way."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    h, v = (h, v) if len(sampling) > 1 else (1, 1)
    mcus = -(-width // (8 * h)) * -(-height // (8 * v))
    scan, bits, pred, blocks = b"", Bits(), [0] * len(sampling), [[] for _ in sampling]
    for m in range(mcus):
        if restart and m and m % restart == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, pred = Bits(), [0] * len(sampling)
        for c, (a, b) in enumerate(sampling):
            for _ in range(a * b if len(sampling) > 1 else 1):
                x = random_block(rng, density)
                encoded(x, pred[c], bits)
                pred[c] = x[0]
                blocks[c].append(x)
    n = len(sampling)
    out = b"\xff\xd8" + j.marker(0xE0, b"JFIF\0") + j.marker(0xDB, b"\x00" + bytes([quantiser] * 64))
    out += j.marker(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(sampling)))
    out += j.marker(0xC4, b"\x00" + j.DC_TABLE[0] + j.DC_TABLE[1] + b"\x10" + j.AC_TABLE[0] + j.AC_TABLE[1])
    if restart:
        out += j.marker(0xDD, struct.pack(">H", restart))
    out += j.marker(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\x00\x3f\x00")
    return out + scan + bits.bytes() + b"\xff\xd9", blocks


CASES = [(8, 8, [(1, 1)], 0, 0.5), (17, 9, [(1, 1)], 2, 0.02), (40, 24, [(2, 2)], 0, 0.9), (33, 47, [(2, 2), (1, 1), (1, 1)], 0, 0.1), (50, 20, [(2, 1), (1, 1), (1, 1)], 3, 0.3), (20, 20, [(1, 1), (1, 1), (1, 1)], 1, 0.0)]


def test_decoder_against_blocks_that_were_written_the_plain_way():
    rng = random.Random(3)
    made = [picture(rng, *case) for case in CASES]
    coded = j.Coded([f for f, _ in made])
    got = np.concatenate([c for _, c in coded.all_coefficients()])
    end = np.cumsum(coded.total)
    for (w, h, sampling, _, _), (_, blocks), f, a, b, p in zip(CASES, made, coded.frames, end - coded.total, end, j.decode([f for f, _ in made])):
        own = got[a:b].reshape(-1, len(f.pattern), 64)
        for c in range(len(sampling)):
            want = np.array(blocks[c])
            assert (own[:, [i for i, x in enumerate(f.pattern) if x == c]].reshape(-1, 64) == want).all()
        assert (p.frame.width, p.frame.height) == (w, h)
        # the thumbnail, pixel by pixel
        H, V = (max(s[k] for s in sampling) for k in (0, 1)) if len(sampling) > 1 else (1, 1)
        sh, sv = sampling[0] if len(sampling) > 1 else (1, 1)
        across = -(-w // (8 * H))
        for y in range(p.thumb.shape[0]):
            for x in range(p.thumb.shape[1]):
                mcu = y // sv * across + x // sh
                dc = blocks[0][mcu * sh * sv + y % sv * sh + x % sh][0]
                assert p.thumb[y, x] == min(255, max(0, (dc * 3 + 4) // 8 + 128))


def test_store_writes_what_the_plain_way_writes():
    rng = random.Random(5)
    payload = bytes(rng.choice([128, 128, 128, 0, 255, 127, 97]) for _ in range(576 * 4)) + bytes([128] * 576) + bytes([128] * 63 + [1]) * 9
    scan = b""
    for i in range(len(payload) // 576):
        bits, before = Bits(), 0
        for b in range(9):
            block = [x - 128 for x in payload[i * 576 + b * 64 : i * 576 + b * 64 + 64]]
            encoded(block, before, bits)
            before = block[0]
        scan += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + bits.bytes()
    (image,) = j.store([payload])
    assert image == j.header(9, len(payload) // 576, len(payload) // 576) + scan + b"\xff\xd9"


@pytest.mark.parametrize("most", [3, j.MOST])
def test_round_trip(monkeypatch, most):
    monkeypatch.setattr(j, "MOST", most)
    monkeypatch.setattr(j, "LANES", 5)
    rng = random.Random(1)
    payloads = [rng.randbytes(576 * n) for n in (1, 2, 7, 20)] + [b"\xff" * 576, b"\x80" * 1152, b"\x00" * 576]
    got = j.decode(j.store(payloads), with_payload=True)
    assert [p.payload for p in got] == payloads


def test_bad_images():
    (good,) = j.store([b"a" * 576])
    for bad in (b"", b"GIF89a", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises((ValueError, struct.error)):
            j.decode([bad])


def test_query_against_the_definition(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 576, 0), (4, "é" * 100_000, 0), (5, "é" * 100_000, 1), (6, "abc", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in q.op4(spark, docs).collect()}
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        (image,) = j.store([payload])
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
    assert got[1][2:] == got[2][2:] and got[4][1:] == got[5][1:] and got[6]["feature"] != got[1]["feature"]
    assert q.op4(spark, docs.where("doc_id < 0")).count() == 0
    assert all(j.decode([bytes(r["image"])])[0].feature == got[r["doc_id"]]["feature"] for r in j.with_images(docs).collect())
