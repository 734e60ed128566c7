import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote, quote_plus

import zstandard

from carelens.llm.secrets import base_matches, scan, scan_secrets

from .util import documents, some_texts

KEY = "AKIA" + "Q7" * 8
SECRET = f'api_key = "{KEY}"'


def brute(text):
    out = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


PLAIN = [SECRET, "ToKeN:'abcdefgh'", "toKen=abcdefgh", "password=short", "passwd = = x", "AKIAAKIAAKIAAKIAZ", "AKIA123 AKIA", "é" * 9 + "secret:" + "a" * 40,
         "token=token=abcdefgh", "deadbeef" * 4 + "g" + "0" * 31]


def test_base_against_brute_force(spark):
    texts = some_texts() + PLAIN
    rows = {r.doc_id: r for r in scan_secrets(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert base_matches(t or "") == want
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(filter(None, listed.split(","))) <= set(rows[i].spans.split(","))
    assert scan_secrets(documents(spark, [])).collect() == []


def wrapped(how, text):
    raw = text.encode()
    return {"url": "".join(f"%{b:02X}" for b in raw), "quote": quote(text, safe=""),
            "unicode": "".join(f"\\u{ord(c):04x}" for c in text), "hex": "".join(f"\\x{b:02x}" for b in raw),
            "base64": base64.b64encode(raw).decode(), "urlsafe": base64.urlsafe_b64encode(raw).decode().rstrip("="),
            "gzip": base64.b64encode(gzip.compress(raw)).decode(), "zlib": base64.b64encode(zlib.compress(raw)).decode(),
            "bz2": base64.b64encode(bz2.compress(raw)).decode()}[how]


def test_nested_layers_map_back():
    for ways in (["url"], ["quote"], ["unicode"], ["hex"], ["base64"], ["urlsafe"], ["gzip"], ["zlib"], ["bz2"], ["base64", "url"],
                 ["gzip", "base64"], ["unicode", "base64", "quote"], ["base64"] * 4, ["zlib", "gzip", "unicode"]):
        inner = f"x {SECRET} y"
        for way in ways:
            inner = wrapped(way, inner)
        text = f"Prose ünd more {inner} after it, token = plainplain1 end."
        base, extra, layers = scan(text)
        assert layers > 1
        a = text.index(inner)
        spans = [(s, e) for s, k, e, _ in extra if k < 2]
        assert spans and all(a <= s < e <= a + len(inner) for s, e in spans), ways
        assert any(text[s:e] == "token = plainplain1" for s, _, e in base)
        assert not any(text[s:e] == "token = plainplain1" for s, _, e, _ in extra)
    text = wrapped("url", SECRET)
    assert [text[s:e] for s, k, e, _ in scan(text)[1] if k == 1] == [wrapped("url", KEY)]


def test_ends_on_odd_input():
    for text in ("%25" * 200 + "41", "%" * 99, "\\u" * 50, "\\ud83d\\ude00 \\ud800", "%FF%FE", "A" * 4000, "eJ" * 40, "%C3%A9" * 10):
        scan(text)
    loop = "QUtJQQ" * 10
    assert scan(loop)[2] < 50


def test_nested_secret_at_two_places():
    for ways in (["url", "base64"], ["unicode", "base64"], ["quote", "url", "base64"], ["url", "gzip"]):
        inner = SECRET
        for way in ways:
            inner = wrapped(way, inner)
        text = f"first {inner} then {inner} end"
        extra = scan(text)[1]
        for a in (text.index(inner), text.rindex(inner)):
            assert any(k == 1 and a <= s < e <= a + len(inner) for s, k, e, _ in extra), ways


def lined(data, width, end):
    return end.join(data[k:k + width] for k in range(0, len(data), width))


def found(text, kind=1):
    return [(s, e) for s, k, e, _ in scan(text)[1] if k == kind]


def test_wrapped_and_glued_base64():
    import random
    prose = " ".join(str(random.Random(4).random()) for _ in range(60))
    for how in ("base64", "gzip", "bz2"):
        for pad in range(0, 48, 5):
            for width, end in ((64, "\n"), (76, "\r\n"), (64, "\n    ")):
                inner = lined(wrapped(how, prose + "+" * pad + SECRET + prose), width, end)
                for text in (f"data: {inner} end", f"data:\n{inner}\n\nthe end"):
                    a = text.index(inner)
                    assert any(a - 80 <= s < e <= a + len(inner) + 80 for s, e in found(text)), (how, pad, width)
        for glue in ("host/", "key_", "a-", "abc/", "x", "/"):
            assert found(glue + wrapped(how, f"x {SECRET} y")), (how, glue)
    inner = wrapped("base64", "ü" * 40 + SECRET + " " * 30)
    text = f"k: {lined(inner, 64, chr(10))}."
    s, e = found(text)[0]
    got = base64.b64decode(text[s:e].replace("\n", ""))
    assert KEY.encode() in got and len(got) < len(KEY) + 6


def test_layers_that_are_not_readable():
    for odd in ("\u00a0", "\u3000", "\ufeff", "\u200b", "\f", "\0", "\x1b[0m", "\x85"):
        for how in ("base64", "gzip", "bz2"):
            assert found(f"a {wrapped(how, odd + SECRET + odd)} b"), (odd, how)
            assert found(f"a {wrapped('base64', wrapped(how, odd + SECRET))} b"), (odd, how)
    for raw in (b"caf\xe9 " + SECRET.encode(), SECRET.encode() + b"\xff\xfe\x80", "ü".encode() + b"\xfc" + SECRET.encode()):
        run = base64.b64encode(raw).decode()
        s, e = found(f"a {run} b")[0]
        assert KEY.encode() in base64.b64decode(run[s - 2:e - 2]) and e - s <= len(KEY) * 4 / 3 + 8
        assert found(f"a {base64.b64encode(gzip.compress(raw)).decode()} b")
    twice = base64.b64encode(zlib.compress(gzip.compress(SECRET.encode()))).decode()
    assert {w for *_, w in scan(twice)[1]} == {"assign/packed", "access/packed"}
    assert scan("x " * 9 + "a" * 40)[2] == 1


def test_all_members_and_all_of_long_data():
    filler, secret = b"plain words " * 500, SECRET.encode()
    zstd = zstandard.ZstdCompressor().compress
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstd):
        for data in (pack(filler) + pack(filler) + pack(secret), pack(filler) + b"\0" * 4 + pack(secret), pack(filler) + zstd(secret),
                     pack(filler + secret[:9]) + pack(secret[9:])):
            run = base64.b64encode(data).decode()
            assert [(2, 2 + len(run))] == found(f"a {run} b"), pack
        for size in range(1000, 1100, 7):      # wherever pieces end, the secret is whole in one
            run = base64.b64encode(pack(filler + secret + filler)).decode()
            assert len([1 for _, k, _, _ in scan(f"a {run} b", size)[1] if k == 1]) == 1
    run = base64.b64encode(b"\x50\x2a\x4d\x18\x03\0\0\0abc" + zstd(secret)).decode()
    assert found(f"a {run} b")
    for pack in (gzip.compress, zlib.compress):     # cut short
        assert found(f"a {base64.b64encode(pack(secret + filler)[:-9]).decode()} b")


def test_data_beyond_the_piece_size():
    packer = zlib.compressobj(1)
    data = b"".join(packer.compress(b"\n" * (1 << 20)) for _ in range(70)) + packer.compress(SECRET.encode()) + packer.flush()
    run = base64.b64encode(data).decode()
    assert found(f"a {run} b")
    assert scan(base64.b64encode(zlib.compress("é".encode() * 999 + SECRET.encode())).decode(), 1001)[1]


def test_compressed_data_as_escapes():
    import json
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        for seed in range(4):
            data = pack(f"{seed} a b {SECRET} plain words {seed}".encode())
            for inner in ("".join(f"%{b:02x}" for b in data), quote(data), quote_plus(data), "".join(f"\\x{b:02x}" for b in data), repr(data)[2:-1],
                          json.dumps(data.decode("latin-1")), "".join(f"\\u{{{b:x}}}" for b in data), quote(quote(data))):
                text = f"Ünd {inner} and 1+1 = 100%25 \\x41 東京 end"
                assert any(4 <= s < e <= 4 + len(inner) for s, e in found(text)), (pack, inner)
    assert {w for *_, w in scan(quote(gzip.compress(SECRET.encode()), safe=""))[1]} == {"assign/packed/url", "access/packed/url"}


def test_valid_parts_of_mixed_runs():
    latin = "".join(f"%{b:02X}" for b in ("ü" + SECRET + "é").encode("latin-1"))
    assert [latin[s:e] for s, e in found(latin)] == ["".join(f"%{b:02X}" for b in KEY.encode())]
    for odd in ("\\ud800", "\\u{110000}", "\\udc00\\ud83d"):
        text = odd + wrapped("unicode", SECRET) + odd
        assert [text[s:e] for s, e in found(text)] == [wrapped("unicode", KEY)]
    plain = "\\ud800" + "deadbeef" * 4 + "\\u0041"
    assert scan(plain)[1] == []


def test_wrapped_blocks_list_each_secret_once():
    secrets = [f"password={hashlib.md5(str(k).encode()).hexdigest()}x" for k in range(400)]
    plain = "\n".join(f"line {k} {s} end" for k, s in enumerate(secrets))
    for width in (64, 76):
        data = base64.b64encode(plain.encode()).decode()
        text = "begin\n" + "\n".join(data[k:k + width] for k in range(0, len(data), width)) + "\nend"
        _, extra, _ = scan(text)
        kinds = [how for *_, how in extra]
        assert kinds.count("assign/base64") == 400 and kinds.count("hex/base64") == 400 and len(extra) == 800
        for a, _, b, how in extra:
            assert not any(x <= a and b <= y and (x, y) != (a, b) and how == h for x, _, y, h in extra)
    twice = base64.encodebytes(base64.encodebytes(plain.encode())).decode()
    _, extra, _ = scan(twice)
    assert sorted(h for *_, h in extra) == ["assign/base64/base64"] * 400 + ["hex/base64/base64"] * 400
