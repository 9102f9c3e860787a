"""Media columns: baseline JPEG written, parsed and Huffman-decoded with numpy.

`store_payloads` keeps bytes as the quantised coefficients of a grey baseline JPEG (entropy coding is
lossless; the quantisers are 1), one block to a restart interval. `read_media` parses markers,
decodes the scans of a whole batch side by side (one lane for each restart interval), rebuilds the
luminance thumbnail from the DC coefficients alone, and hashes it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Payloads are filled up to a multiple of this: 3 x 3 blocks of 64 coefficients.
UNIT = 576
#: Blocks coded at once, and lanes decoded at once: bounds the memory of a text of any length, and
#: keeps the arrays in a processor's cache.
SLICE, LANES = 512, 4096

# --- Huffman tables of the writer, from a rule --------------------------------------------------
# DC: the 12 sizes, 4 bits each. AC: end of block and run 0 with sizes 1-10, 4 bits each; then all
# other symbols (run 15 of zeros, runs 1-15 with sizes 1-10), 12 bits each.
DC_SYMBOLS = bytes(range(12))
AC_SHORT = bytes(range(11))
AC_LONG = bytes(r << 4 | s for r in range(1, 16) for s in range(1, 11)) + bytes([0xF0])
DC_COUNTS = bytes([0, 0, 0, 12] + [0] * 12)
AC_COUNTS = bytes([0, 0, 0, len(AC_SHORT)] + [0] * 7 + [len(AC_LONG)] + [0] * 4)


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) by the canonical rule of the standard."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def _encode_arrays(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c, n in canonical(counts, symbols):
        codes[s], lengths[s] = c, n
    return codes, lengths


DC_CODE, DC_LEN = _encode_arrays(DC_COUNTS, DC_SYMBOLS)
AC_CODE, AC_LEN = _encode_arrays(AC_COUNTS, AC_SHORT + AC_LONG)
SIZE_OF = np.array([int(v).bit_length() for v in range(2048)], np.int64)


def _amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


def _code_blocks(c: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-code blocks (n, 64), each byte-aligned, stuffed and followed by its marker (FF, markers[i]).

    Returns the bytes and where each block ends.
    """
    n = len(c)
    b, k = np.nonzero(c[:, 1:])
    k = k + 1
    v = c[b, k]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    before = np.zeros(len(b), np.int64)
    before[1:] = k[:-1]
    before[first] = 0
    run = k - before - 1
    size = SIZE_OF[np.abs(v)]
    sym = (run & 15) << 4 | size
    zrl, zlen = run >> 4, int(AC_LEN[0xF0])
    code = AC_CODE[sym] << size.astype(np.uint64) | _amplitude(v, size)
    length = AC_LEN[sym] + size
    for times in (1, 2, 3):
        more = zrl == times
        if more.any():
            head = np.uint64(0)
            for _ in range(times):
                head = head << np.uint64(zlen) | AC_CODE[0xF0]
            code[more] |= head << length[more].astype(np.uint64)
            length[more] += times * zlen

    nnz = np.bincount(b, minlength=n)
    last = np.zeros(n, np.int64)
    last[b] = k  # in order: the last one stays
    eob = last < 63
    per = 3 + nnz  # DC, AC, end of block, padding
    start = np.concatenate([[0], np.cumsum(per)])
    codes, lengths = np.zeros(start[-1], np.uint64), np.zeros(start[-1], np.int64)
    dc = c[:, 0]
    dsize = SIZE_OF[np.abs(dc)]
    codes[start[:-1]] = DC_CODE[dsize] << dsize.astype(np.uint64) | _amplitude(dc, dsize)
    lengths[start[:-1]] = DC_LEN[dsize] + dsize
    at = np.arange(len(b)) + 1 + 3 * b  # earlier blocks have three more items each, this one its DC
    codes[at], lengths[at] = code, length
    codes[start[1:] - 2] = AC_CODE[0]
    lengths[start[1:] - 2] = np.where(eob, AC_LEN[0], 0)
    bits = np.add.reduceat(lengths, start[:-1])
    n_bytes = -(-bits // 8)
    pad = n_bytes * 8 - bits
    codes[start[1:] - 1] = (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)
    lengths[start[1:] - 1] = pad

    end = np.cumsum(lengths)
    pos = end - lengths  # blocks are whole bytes now, so this is their place as well
    some = lengths > 0
    pos, codes, lengths = pos[some], codes[some], lengths[some]
    left = codes << (64 - lengths).astype(np.uint64)
    word, shift = pos >> 6, (pos & 63).astype(np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    words[word[cut]] |= np.bitwise_or.reduceat(left >> shift, cut)
    spill = np.where(shift > 0, left << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    words[word[cut] + 1] |= np.bitwise_or.reduceat(spill, cut)
    data = words.byteswap().view(np.uint8)[: int(n_bytes.sum())]

    full = data == 255
    block = np.repeat(np.arange(n), n_bytes)
    target = np.arange(len(data)) + (np.cumsum(full) - full) + 2 * block
    out = np.zeros(len(data) + int(full.sum()) + 2 * n, np.uint8)
    out[target] = data
    ends = np.cumsum(n_bytes + np.bincount(block, weights=full, minlength=n).astype(np.int64) + 2)
    out[ends - 2], out[ends - 1] = 255, markers
    return out, ends


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG for each payload (a multiple of 64 bytes); its length is in a comment."""
    shapes = []
    for p in payloads:
        blocks = len(p) // 64
        wide = 9 * max(1, -(-blocks // (9 * 8191)))
        shapes.append((wide, -(-blocks // wide)))
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_COUNTS + AC_SHORT + AC_LONG) + _segment(0xDD, b"\0\1")
    parts: list[list[bytes]] = [[] for _ in payloads]
    group: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def flush():
        if group:
            out, ends = _code_blocks(np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group]))
            at, begin = 0, 0
            for i, c, _ in group:
                at += len(c)
                parts[i].append(out[begin : ends[at - 1]].tobytes())
                begin = ends[at - 1]
            group.clear()

    for i, p in enumerate(payloads):
        wide, high = shapes[i]
        total = wide * high
        for a in range(0, total, SLICE):
            z = min(total, a + SLICE)
            c = np.zeros((z - a, 64), np.int64)
            own = np.frombuffer(p[a * 64 : z * 64], np.uint8).astype(np.int64) - 128
            c.reshape(-1)[: len(own)] = own
            m = (0xD0 + np.arange(a, z) % 8).astype(np.uint8)
            if z == total:
                m[-1] = 0xD9
            group.append((i, c, m))
            held += z - a
            if held >= SLICE:
                flush()
                held = 0
    flush()
    out = []
    for i, p in enumerate(payloads):
        wide, high = shapes[i]
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + tables + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0")
        out.append(head + _segment(0xDA, b"\1\1\0\0\x3f\0") + b"".join(parts[i]))
    return out


# --- reading -----------------------------------------------------------------------------------


@dataclass
class Scan:
    """Markers of one image, and its entropy-coded data as lanes: one for each restart interval."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict = field(default_factory=dict)
    huff: dict = field(default_factory=dict)
    comps: list = field(default_factory=list)  # (id, h, v, quantiser)
    restart: int = 0
    order: list = field(default_factory=list)  # of the scan: (component index, DC table, AC table)
    data: np.ndarray | None = None
    starts: np.ndarray | None = None


def parse(jpeg: bytes) -> list[Scan]:
    """Walk the markers: one Scan for each SOS. ValueError for what is not baseline."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    raw = np.frombuffer(jpeg, np.uint8)
    at, now, scans = 2, Scan(), []
    while at + 4 <= len(jpeg):
        if jpeg[at] != 255:
            raise ValueError("marker expected")
        kind = jpeg[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        (size,) = struct.unpack_from(">H", jpeg, at + 2)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            now.comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                now.quant = {**now.quant, body[0] & 15: np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)}
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                now.huff = {**now.huff, body[0]: (body[1:17], body[17 : 17 + n])}
                body = body[17 + n :]
        elif kind == 0xC0:
            bits, now.height, now.width, n = struct.unpack_from(">BHHB", body)
            now.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8:
                raise ValueError("8-bit samples expected")
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xDD:
            (now.restart,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            ids = [c[0] for c in now.comps]
            now.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            rest = raw[at:]
            ff = np.flatnonzero(rest[:-1] == 255)
            nxt = rest[ff + 1]
            rst = (nxt >= 0xD0) & (nxt <= 0xD7)
            stop = ff[(nxt != 0) & ~rst]
            end = int(stop[0]) if len(stop) else len(rest)
            inside = ff < end
            keep = np.ones(end, bool)
            keep[ff[inside & (nxt == 0)] + 1] = False
            marks = ff[inside & rst]
            keep[marks] = keep[marks + 1] = False
            kept = np.cumsum(keep)
            scan = Scan(**{**now.__dict__, "data": rest[:end][keep], "starts": np.concatenate([[0], kept[marks]]).astype(np.int64)})
            scans.append(scan)
            at += end
    if not scans:
        raise ValueError("no scan")
    return scans


_luts: dict[tuple, np.ndarray] = {}


def _lut(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; length 0 where no code fits."""
    key = (counts, symbols)
    if key not in _luts:
        table = np.zeros(1 << 16, np.int32)
        for s, code, n in canonical(counts, symbols):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
        _luts[key] = table
    return _luts[key]


def _layout(s: Scan) -> tuple[list[int], int, int]:
    """Blocks of an MCU as indexes into s.order, MCUs across and down."""
    most_h, most_v = max(c[1] for c in s.comps), max(c[2] for c in s.comps)
    if len(s.order) == 1:
        _, h, v, _ = s.comps[s.order[0][0]]
        return [0], -(-(-(-s.width * h // most_h)) // 8), -(-(-(-s.height * v // most_v)) // 8)
    seq = [i for i, (c, _, _) in enumerate(s.order) for _ in range(s.comps[c][1] * s.comps[c][2])]
    return seq, -(-s.width // (8 * most_h)), -(-s.height // (8 * most_v))


def decode_scans(scans: list[Scan]) -> list[np.ndarray]:
    """The quantised coefficients of each scan's blocks in coding order, in zigzag order within a block."""
    luts, lut_no, jobs = [], {}, []
    for s in scans:
        seq, across, down = _layout(s)
        mcus = across * down
        own = []
        for _, d, a in s.order:
            for key in (s.huff[d], s.huff[16 | a]):
                if key not in lut_no:
                    lut_no[key] = len(luts)
                    luts.append(_lut(*key))
            own.append((lut_no[s.huff[d]], lut_no[s.huff[16 | a]]))
        lanes = len(s.starts) if s.restart else 1
        each = np.full(lanes, s.restart or mcus)
        each[-1] = mcus - (lanes - 1) * (s.restart or mcus)
        jobs.append((seq, own, each * len(seq), mcus * len(seq)))
    table = np.concatenate(luts)
    most = max(len(j[0]) for j in jobs)
    out = [np.zeros((j[3], 64), np.int16) for j in jobs]
    at, group, held = 0, [], 0
    for i, (s, j) in enumerate(zip(scans, jobs, strict=True)):
        for a in range(0, len(j[2]), LANES):
            group.append((i, a, min(len(j[2]), a + LANES)))
            held += group[-1][2] - a
            if held >= LANES:
                _decode_lanes(scans, jobs, group, table, most, out)
                group, held = [], 0
    if group:
        _decode_lanes(scans, jobs, group, table, most, out)
    return out


def _decode_lanes(scans, jobs, group, table, most, out) -> None:
    """All lanes of the group one symbol at a time."""
    data, pos, todo, base, dc_lut, ac_lut, comp, mcu = [], [], [], [], [], [], [], []
    offset, blocks, spans = 0, 0, []
    for i, a, z in group:
        s, (seq, own, each, _) = scans[i], jobs[i]
        lo = int(s.starts[a])
        hi = int(s.starts[z]) if z < len(s.starts) else len(s.data)
        data.append(s.data[lo:hi])
        pos.append((s.starts[a:z] - lo + offset) * 8)
        offset += hi - lo
        n = each[a:z]
        todo.append(n)
        base.append(np.cumsum(n) - n + blocks)
        spans.append((i, int(each[:a].sum()), blocks, int(n.sum())))
        blocks += int(n.sum())
        pad = [0] * (most - len(seq))
        dc_lut.append(np.tile([own[x][0] for x in seq] + pad, (z - a, 1)))
        ac_lut.append(np.tile([own[x][1] for x in seq] + pad, (z - a, 1)))
        comp.append(np.tile(list(seq) + pad, (z - a, 1)))
        mcu.append(np.full(z - a, len(seq)))
    raw = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.int64)
    window = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]  # 40 bits from each byte on
    pos, todo, base, mcu = (np.concatenate(x) for x in (pos, todo, base, mcu))
    dc_lut, ac_lut, comp = (np.concatenate(x) for x in (dc_lut, ac_lut, comp))
    coef = np.zeros((blocks, 64), np.int16)
    flat = coef.reshape(-1)
    n = len(pos)
    lane, k, block = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pred = np.zeros((n, int(comp.max()) + 1), np.int64)
    single = most == 1 and len(table) == 2 << 16
    last = (len(window) - 1) * 8
    while len(lane):
        dc = k == 0
        some_dc = dc.any()
        if single and not some_dc:
            lut = ac_lut[0, 0]
        elif single:
            lut = np.where(dc, dc_lut[0, 0], ac_lut[0, 0])
        else:
            turn = block % mcu
            lut = np.where(dc, dc_lut[lane, turn], ac_lut[lane, turn])
        bits = window[pos >> 3] << (pos & 7)
        e = table[lut << 16 | ((bits >> 24) & 0xFFFF)]
        length, sym = e >> 8, (e & 255).astype(np.int64)
        if not length.all():
            raise ValueError("a code that no table has")
        run, size = sym >> 4, sym & 15
        if some_dc:
            run[dc] = 0
            size[dc] = sym[dc]
        extra = (bits >> (40 - length - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        pos += length + size
        k += run
        nil = size == 0
        if some_dc:
            nil &= ~dc
            d = np.flatnonzero(dc)
            c = 0 if single else comp[lane[d], block[d] % mcu[d]]
            value[d] += pred[lane[d], c]
            pred[lane[d], c] = value[d]
        some_nil = nil.any()
        put = ~nil if some_nil else slice(None)
        if int(k.max()) > 63 and (k[put] > 63).any():
            raise ValueError("a run beyond its block")
        flat[((base + block) * 64 + k)[put]] = value[put]
        k += 1
        if some_nil:
            k[nil & (run < 15)] = 64
        over = k > 63
        if over.any():
            block[over] += 1
            k[over] = 0
            done = block >= todo
            if (pos > last).any():
                raise ValueError("the data ends early")
            if done.any():
                live = ~done
                lane, k, block, pos, todo, base, mcu = (x[live] for x in (lane, k, block, pos, todo, base, mcu))
    for i, first, at, count in spans:
        out[i][first : first + count] = coef[at : at + count]


def thumbnail(s: Scan, coef: np.ndarray) -> np.ndarray:
    """Luminance from the DC coefficients alone: one 8-bit sample for each block of the first component."""
    seq, across, down = _layout(s)
    which = next(i for i, (c, _, _) in enumerate(s.order) if c == 0)
    _, h, v, q = s.comps[0]
    dc = coef[:, 0].reshape(across * down, len(seq))[:, [i for i, x in enumerate(seq) if x == which]].astype(np.int64)
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h) if len(seq) > 1 else dc.reshape(down, across)
    return np.clip((grid * s.quant[q][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: on an 8 x 9 grid of the thumbnail, is a sample brighter than the one to its left."""
    y = np.arange(8) * thumb.shape[0] // 8
    x = np.arange(9) * thumb.shape[1] // 9
    g = thumb[np.ix_(y, x)].astype(np.int16)
    return int.from_bytes(np.packbits((g[:, 1:] > g[:, :-1]).ravel()).tobytes(), "big")


def read_batch(media: list[bytes | None]) -> list[dict]:
    """width, height, thumbnail (rows of bytes), hash, payload (None without the writer's comment), error."""
    out: list[dict] = [{"width": None, "height": None, "thumb": None, "dhash": None, "payload": None, "error": None} for _ in media]
    held: list[tuple[int, Scan]] = []
    for i, m in enumerate(media):
        try:
            if m is None:
                raise ValueError("no media")
            scans = parse(bytes(m))
            held.append((i, next(s for s in scans if any(c == 0 for c, _, _ in s.order))))
        except (ValueError, IndexError, KeyError, struct.error, StopIteration) as e:
            out[i]["error"] = str(e) or type(e).__name__
    try:
        coefs = decode_scans([s for _, s in held]) if held else []
    except (ValueError, IndexError, KeyError):
        # One image of the batch is damaged: find it.
        if len(held) == 1:
            out[held[0][0]]["error"] = "damaged scan"
            return out
        for i, _ in held:
            out[i] = read_batch([media[i]])[0]
        return out
    for (i, s), c in zip(held, coefs, strict=True):
        t = thumbnail(s, c)
        out[i] |= {"width": s.width, "height": s.height, "thumb": t, "dhash": difference_hash(t)}
        if s.comment.startswith(b"payload "):
            out[i]["payload"] = (c.reshape(-1)[: int(s.comment[8:])] + 128).astype(np.uint8).tobytes()
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def _runs(sizes: list[int], most: int = 1 << 21):
    """Ranges of rows of about `most` bytes."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i == len(sizes) - 1:
            yield at, i + 1
            at, held = i + 1, 0


def store_payloads(docs: DataFrame, text_col: str = "text", name: str = "media") -> DataFrame:
    """docs with each whole text stored as a JPEG. Null counts as empty: one unit of bytes 255."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        payloads = [payload_of(t) for t in texts]
        out = []
        for a, z in _runs([len(p) for p in payloads]):
            out += encode_payloads(payloads[a:z])
        return pd.Series(out, dtype=object)

    return docs.withColumn(name, store(F.col(text_col)))


FEATURES = "width int, height int, thumbnail_sha256 string, dhash string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"


def read_media(media: DataFrame, col: str = "media", name: str = "features") -> DataFrame:
    """media with a struct of dimensions, thumbnail hashes and the payload's digests, from the stored bytes.

    A null or damaged image, or one that is not baseline, has nulls and says why in `error`; other
    images without the writer's comment have null payload fields; an empty input gives an empty
    result; all columns are kept.
    """

    @F.pandas_udf(FEATURES)
    def read(blobs: pd.Series) -> pd.DataFrame:
        rows, blobs = [], list(blobs)
        for a, z in _runs([len(b) if b is not None else 0 for b in blobs]):
            for r in read_batch(blobs[a:z]):
                p, t = r["payload"], r["thumb"]
                rows.append(
                    (
                        r["width"],
                        r["height"],
                        None if t is None else hashlib.sha256(t.tobytes()).hexdigest(),
                        None if t is None else f"{r['dhash']:016x}",
                        None if p is None else len(p),
                        None if p is None else hashlib.sha256(p).hexdigest(),
                        None if p is None else zlib.crc32(p[-32:]),
                        r["error"],
                    )
                )
        out = pd.DataFrame(rows, columns=["width", "height", "thumbnail_sha256", "dhash", "payload_bytes", "payload_sha256", "tail_crc32", "error"])
        return out.astype({"width": "Int32", "height": "Int32", "payload_bytes": "Int64", "tail_crc32": "Int64"})

    return media.withColumn(name, read(F.col(col)))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(store_payloads(documents(spark, sf_dir).select("doc_id", "text")))
    f = F.col("features")
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        f["payload_bytes"].alias("payload_bytes"),
        f["payload_sha256"].alias("payload_sha256"),
        f["tail_crc32"].alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", f["width"], f["height"], f["dhash"], f["thumbnail_sha256"]).alias("feature"),
        f["error"].alias("error"),
    )


QUERIES = {"op3_jpeg_media": op3_jpeg_media}
