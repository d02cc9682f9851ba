"""TIFF images: writing byte payloads losslessly and reading images page by page.

Reading walks the image directories, decodes PackBits, LZW, deflate and plain
strips and tiles, undoes the horizontal and the floating point predictor and
gives one row for each page.  Samples have 1, 2, 4, 8, 16, 32 or 64 bits, all of
a pixel together or in planes; bits of a byte stand in either order.  Writing stores a payload as 8-bit grey rows; the pages take the codings
in turn, the first by a checksum of the payload, so that each coding is in use
for a third of the pages and equal payloads are stored alike.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.rows import map_rows

#: Width of a stored image, rows of a page and of a strip; tiles of LZW pages.
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 64, 16, (192, 16)

#: Bytes of a page that is read, at most, and of what one stored byte can stand for in any coding; a page beyond either gives a row with an error.
MOST_BYTES, MOST_RATIO = 1 << 30, 2048

#: Tags and codings of the format.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_CODING, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIPS, TAG_SAMPLES, TAG_STRIP_ROWS, TAG_STRIP_BYTES, TAG_PLANAR = 273, 277, 278, 279, 284
TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILES, TAG_TILE_BYTES = 317, 322, 323, 324, 325
TAG_FILL_ORDER, TAG_SAMPLE_FORMAT, FLOATS = 266, 339, 3
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
CLEAR, END = 256, 257
#: Codes from a clearing one until the table is full.
SEGMENT = 4096 - (CLEAR + 2)
#: The codings that writing takes in turn.
TURN = (DEFLATE, PACKBITS, LZW)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three equal bytes or more are counted, the rest is copied."""
    out, n, at = bytearray(), len(data), 0
    buf = np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(buf[1:] != buf[:-1]) + 1, [n])) if n else np.zeros(1, int)
    sizes = np.diff(edges)

    def copy(end: int) -> None:
        nonlocal at
        while at < end:
            k = min(128, end - at)
            out.append(k - 1)
            out.extend(data[at : at + k])
            at += k

    for run in np.flatnonzero(sizes >= 3):
        copy(int(edges[run]))
        left = int(sizes[run])
        while left > 1:
            k = min(128, left)
            out.append(257 - k)
            out.append(data[at])
            at, left = at + k, left - k
    copy(n)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    """At least size bytes, where data has as many."""
    out, at, made = [], 0, 0
    while at < len(data) and made < size:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
            made += n + 1
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            made += 257 - n
        else:
            at += 1
    return b"".join(out)


def _widths() -> np.ndarray:
    """Bits of each code after a clearing one: each adds an entry, and one entry early the codes get longer."""
    entries = CLEAR + 2 + np.arange(SEGMENT)
    return np.select([entries < 512, entries < 1024, entries < 2048], [9, 10, 11], 12)


WIDTHS = _widths()
STARTS = np.cumsum(WIDTHS) - WIDTHS
#: The same where a full table is not cleared.
LONGEST = np.arange(SEGMENT) * 12, np.full(SEGMENT, 12)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one code longer one entry early."""
    codes, ends = [CLEAR], [1]
    table: dict[int, int] = {}
    known, free, last = table.get, CLEAR + 2, -1
    for byte in data:
        if last < 0:
            last = byte
            continue
        pair = last << 8 | byte
        code = known(pair)
        if code is not None:
            last = code
            continue
        codes.append(last)
        table[pair] = free
        free += 1
        if free == 4095:
            codes.append(CLEAR)
            ends.append(len(codes))
            table.clear()
            free = CLEAR + 2
        last = byte
    if last >= 0:
        codes.append(last)
    codes.append(END)
    ends.append(len(codes))
    widths = np.concatenate([WIDTHS[:1], *(WIDTHS[: end - start] for start, end in zip(ends, ends[1:]))])
    bits = np.array(codes)[:, None] >> np.arange(11, -1, -1) & 1
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    """At least size bytes, where data has as many."""
    single = [bytes([n]) for n in range(256)] + [b"", b""]
    buf = np.frombuffer(data + b"\0\0\0", np.uint8)
    table, out, before, made = list(single), [], b"", 0
    at = 9 if len(data) > 1 and data[0] << 1 | data[1] >> 7 == CLEAR else 0
    starts, widths = STARTS, WIDTHS
    while True:
        # all codes up to where the table is full, as if none of them cleared it
        n = int(np.searchsorted(starts + widths, len(data) * 8 - at, "right"))
        place = starts[:n] + at
        byte = place >> 3
        window = buf[byte].astype(np.int32) << 16 | buf[byte + 1].astype(np.int32) << 8 | buf[byte + 2]
        codes = (window >> 24 - (place & 7) - widths[:n] & (1 << widths[:n]) - 1).tolist()
        k = -1
        for k, code in enumerate(codes):
            if code == CLEAR or code == END:
                break
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            made += len(entry)
            if made >= size:
                return b"".join(out)
            if before:
                table.append(before + entry[:1])
            before = entry
        if k < 0 or codes[k] == END:
            return b"".join(out)
        at += int(starts[k] + widths[k])
        if codes[k] == CLEAR:
            table, before, starts, widths = list(single), b"", STARTS, WIDTHS
        else:
            starts, widths = LONGEST
    

def decode(data: bytes, coding: int, size: int) -> bytes:
    """The bytes of a strip or tile; what comes after size of them need not be there."""
    if coding == PLAIN:
        return data
    if coding == LZW:
        return unlzw(data, size)
    if coding in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if coding == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"coding {coding}")


def encode(data: bytes, coding: int) -> bytes:
    if coding == PLAIN:
        return data
    return lzw(data) if coding == LZW else zlib.compress(data, 6) if coding == DEFLATE else pack_bits(data)


def _differences(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def write(payload: bytes, *, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> bytes:
    """A TIFF whose pages hold payload, a positive multiple of width, as 8-bit grey rows.

    Pages take deflate with predictor in strips, PackBits in strips, and LZW with
    predictor in tiles, in turn, from one of them on by the payload's checksum.
    LZW pages lower than a tile are strips, as a tile would be mostly empty.
    """
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = [b"II*\0\x08\0\0\0"]
    at = 8
    pages = [pixels[n : n + page_rows] for n in range(0, len(pixels), page_rows)]
    first = zlib.crc32(payload) % len(TURN)
    for n, page in enumerate(pages):
        coding = TURN[(first + n) % len(TURN)]
        predictor = 1 if coding == PACKBITS else 2
        tags = {TAG_WIDTH: [width], TAG_HEIGHT: [len(page)], TAG_BITS: [8], TAG_CODING: [coding], TAG_PHOTOMETRIC: [1], TAG_SAMPLES: [1], TAG_PREDICTOR: [predictor]}
        if coding == LZW and width % TILE[0] == 0 and len(page) >= TILE[1]:
            parts = []
            for top in range(0, len(page), TILE[1]):
                for left in range(0, width, TILE[0]):
                    tile = np.zeros((TILE[1], TILE[0]), np.uint8)
                    cut = page[top : top + TILE[1], left : left + TILE[0]]
                    tile[: len(cut)] = cut
                    parts.append(encode(_differences(tile).tobytes(), coding))
            tags |= {TAG_TILE_WIDTH: [TILE[0]], TAG_TILE_HEIGHT: [TILE[1]]}
            places = TAG_TILES, TAG_TILE_BYTES
        else:
            strips = [page[top : top + STRIP_ROWS] for top in range(0, len(page), STRIP_ROWS)]
            if predictor == 2:
                parts = [encode(_differences(s).tobytes(), coding) for s in strips]
            else:
                parts = [b"".join(encode(row.tobytes(), coding) for row in s) for s in strips]
            tags |= {TAG_STRIP_ROWS: [STRIP_ROWS]}
            places = TAG_STRIPS, TAG_STRIP_BYTES
        # the directory stands before its data, so its size comes first
        size = 2 + 12 * (len(tags) + 2) + 4
        extra = 8 * len(parts) if len(parts) > 1 else 0
        offsets, cursor = [], at + size + extra
        for p in parts:
            offsets.append(cursor)
            cursor += len(p)
        pad = cursor % 2
        tags |= {places[0]: offsets, places[1]: [len(p) for p in parts]}
        entries, spill = [], b""
        for tag in sorted(tags):
            values = tags[tag]
            body = struct.pack(f"<{len(values)}I", *values)
            if len(body) > 4:
                spill, body = spill + body, struct.pack("<I", at + size + len(spill))
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + body)
        following = cursor + pad if n + 1 < len(pages) else 0
        out += [struct.pack("<H", len(entries)), *entries, struct.pack("<I", following), spill, *parts, b"\0" * pad]
        at = cursor + pad
    return b"".join(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and tags of each image directory, in the order of their links; a link back ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            letter = KINDS.get(kind)
            if letter is None:
                continue
            size = struct.calcsize(letter) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if place + size > len(data):
                raise ValueError("a tag beyond the end")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _samples(raw: bytes, shape: tuple[int, int, int], bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The samples of a part, its predictor undone; shape: rows, columns, samples. Samples of less than a byte take one each; their rows begin with a byte."""
    rows, columns, samples = shape
    if bits < 8:
        line = (columns * samples * bits + 7) // 8
        apart = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : columns * samples * bits]
        return np.packbits(apart.reshape(rows, columns, samples, bits), axis=3)[..., 0] >> (8 - bits)
    if predictor == 3:
        # bytes of a row stand by their rank in a sample, highest first, as differences
        line = np.frombuffer(raw, np.uint8, rows * columns * samples * kind.itemsize).reshape(rows, -1, samples)
        ranked = np.cumsum(line, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * samples)
        return np.ascontiguousarray(ranked.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape).astype(kind.newbyteorder("="))
    part = np.frombuffer(raw, kind, rows * columns * samples).reshape(shape).astype(kind.newbyteorder("="), copy=False)
    return np.cumsum(part, axis=1, dtype=part.dtype) if predictor == 2 else part


def _turned(data: bytes) -> bytes:
    """Each byte with its bits in the other order."""
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 1), axis=1)[:, ::-1], axis=1).tobytes()


def pixels(data: bytes, order: str, tags: dict[int, list]) -> np.ndarray:
    """A page's samples: rows, columns, samples of a pixel."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(TAG_WIDTH, 0), one(TAG_HEIGHT, 0), one(TAG_SAMPLES, 1)
    bits, coding, predictor, planar = one(TAG_BITS, 1), one(TAG_CODING, 1), one(TAG_PREDICTOR, 1), one(TAG_PLANAR, 1)
    floats = one(TAG_SAMPLE_FORMAT, 1) == FLOATS
    predictors = {False: (1, 2) if bits >= 8 else (1,), True: (1, 3)}[floats]
    if bits not in ((32, 64) if floats else (1, 2, 4, 8, 16, 32, 64)) or len(set(tags.get(TAG_BITS, [1]))) > 1 or predictor not in predictors or planar not in (1, 2) or samples < 1:
        raise ValueError("a kind of samples that is not supported")
    kind = np.dtype(f"{order}{'f' if floats else 'u'}{max(1, bits // 8)}")
    tiled = TAG_TILES in tags
    across, down = (one(TAG_TILE_WIDTH, width), one(TAG_TILE_HEIGHT, height)) if tiled else (width, min(height, one(TAG_STRIP_ROWS, height)))
    if not width or not height or not across or not down:
        raise ValueError("an image without pixels")
    places, sizes = (tags[TAG_TILES], tags[TAG_TILE_BYTES]) if tiled else (tags[TAG_STRIPS], tags[TAG_STRIP_BYTES])
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(places) != len(sizes) or len(places) != planes * -(-width // across) * -(-height // down):
        raise ValueError("as many parts as the image needs are not there")
    whole = height * width * samples * kind.itemsize
    # a bit that is stored may become a byte
    if whole > MOST_BYTES or whole > MOST_RATIO * len(data) * max(1, 8 // bits) or down * across * each * kind.itemsize > MOST_BYTES:
        raise ValueError("an image larger than its data can fill")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    turned = one(TAG_FILL_ORDER, 1) == 2
    n = 0
    for plane in range(planes):
        held = out[:, :, plane : plane + each]
        for top in range(0, height, down):
            for left in range(0, width, across):
                rows = down if tiled else min(down, height - top)
                part = data[places[n] : places[n] + sizes[n]]
                raw = decode(_turned(part) if turned else part, coding, rows * ((across * each * bits + 7) // 8))
                held[top : top + rows, left : left + across] = _samples(raw, (rows, across, each), bits, kind, predictor)[: height - top, : width - left]
                n += 1
    return out


PAGE = "page int, width long, height long, samples int, bits int, coding int, predictor int, tiled boolean, pixels binary, error string"


def read_pages(data: bytes | None) -> Iterator[tuple]:
    """Rows of PAGE. A page that can't be read, or bytes that are no TIFF, give a row with error; null or no bytes give none."""
    page = -1
    try:
        for page, (order, tags) in enumerate(directories(data) if data else ()):
            one = lambda tag, default, tags=tags: tags.get(tag, [default])[0]
            about = (page, one(TAG_WIDTH, 0), one(TAG_HEIGHT, 0), one(TAG_SAMPLES, 1), one(TAG_BITS, 1), one(TAG_CODING, 1), one(TAG_PREDICTOR, 1), TAG_TILES in tags)
            try:
                yield (*about, pixels(data, order, tags).tobytes(), None)
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                yield (*about, None, str(e))
    except (ValueError, IndexError, struct.error) as e:
        yield (page + 1, None, None, None, None, None, None, None, None, str(e))


def pages(images: DataFrame, *, id_col: str, image_col: str) -> DataFrame:
    """id and PAGE: one row for each page of each image."""
    return map_rows(images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image")), ["id", "image"], f"id long, {PAGE}", lambda: lambda key, image: ((key, *p) for p in read_pages(image)))


def pad(text: bytes, unit: int = WIDTH) -> bytes:
    """text and bytes 255 up to a positive multiple of unit."""
    return text + b"\xff" * (-len(text) % unit if text else unit)


def feature(samples: list[bytes]) -> str:
    """Pages, sum and number of distinct values of the samples, and a 64-bit difference hash of their mean rows."""
    rows = np.concatenate([np.frombuffer(s, np.uint8).reshape(-1, WIDTH) for s in samples])
    counts = np.bincount(rows.reshape(-1), minlength=256)
    column = rows.sum(axis=0, dtype=np.int64)[: WIDTH // 65 * 65].reshape(65, -1).sum(axis=1)
    bits = np.packbits(column[1:] > column[:-1]).tobytes().hex()
    return f"{len(samples)}:{int((counts * np.arange(256)).sum())}:{int((counts > 0).sum())}:{bits}"


def _through(doc_id: int, text: str | None) -> Iterator[tuple]:
    data = (text or "").encode()
    image = write(pad(data))
    samples = []
    for p in read_pages(image):
        if p[-1]:
            raise ValueError(p[-1])
        samples.append(p[-2])
    back = b"".join(samples)
    yield (
        doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(image), hashlib.sha256(image).hexdigest(),
        feature(samples), len(samples),
    )


def images(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, image: each text as a TIFF. Null text: empty."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], "id long, image binary", lambda: lambda key, text: [(key, write(pad((text or "").encode())))])


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a TIFF, read back page by page and described; one row for each row of docs.

    Null text: empty, so one row of bytes 255.  Images are made and read within
    a task and never shuffled.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(
        picked, ["doc_id", "text"],
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int",
        lambda: _through,
    )
