"""MPEG transport streams as a media column: a writer and a parser.

A stream is 188-byte packets.  The parser reads the program association table,
then each program's map table, then reassembles every elementary stream's
packets, checks continuity counters, and keeps the presentation and decoding
timestamps and the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_STREAM_1, PRIVATE_DATA = 188, 0x47, 0x0000, 0x1FFF, 0xBD, 0x06
CRC_POLY = 0x04C11DB7

PMT_PID, DATA_PID = 0x0100, 0x0101
#: Payload bytes in an elementary packet; its 16-bit length field allows 65,527.
UNIT = 32_768
#: Clock ticks (90 kHz) between units.
TICKS = 3_600


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = ((r << 1) ^ CRC_POLY if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


def crc32_mpeg(data: bytes) -> int:
    table, r = _crc_table(), 0xFFFFFFFF
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ table[(r >> 24) ^ b]
    return r


def _section_packet(pid: int, table_id: int, body: bytes, counter: int) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15, 0]) + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=4)
def _tables(program: int) -> bytes:
    pat = (1).to_bytes(2, "big") + b"\xc1\0\0" + program.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    pmt = program.to_bytes(2, "big") + b"\xc1\0\0" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
    return _section_packet(PAT_PID, 0x00, pat, 0) + _section_packet(PMT_PID, 0x02, pmt, 0)


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def write_stream(payload: bytes, program: int = 1, unit: int = UNIT) -> bytes:
    """The payload as private data, a unit of it per elementary packet, each
    with a timestamp, a clock reference and a random-access mark."""
    out, counter, pid = [_tables(program)], 0, DATA_PID.to_bytes(2, "big")
    first = (0x4000 | DATA_PID).to_bytes(2, "big")
    heads = [bytes([SYNC]) + pid + bytes([0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        t = k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\5" + _stamp(2, t) + data
        clock = (t << 15 | 0x7E00).to_bytes(6, "big")
        room, used = PACKET - 12, min(PACKET - 12, len(pes))
        field = b"\x50" + clock + b"\xff" * (room - used)
        out.append(bytes([SYNC]) + first + bytes([0x30 | counter, len(field)]) + field + pes[:used])
        counter = counter + 1 & 15
        whole = used + (len(pes) - used) // 184 * 184
        for i in range(used, whole, 184):
            out.append(heads[counter])
            out.append(pes[i : i + 184])
            counter = counter + 1 & 15
        if whole < len(pes):
            rest = pes[whole:]
            pad = 183 - len(rest)
            field = b"\0" + b"\xff" * (pad - 1) if pad else b""
            out.append(bytes([SYNC]) + pid + bytes([0x30 | counter, len(field)]) + field + rest)
            counter = counter + 1 & 15
    return b"".join(out)


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


class Sections:
    """Puts the sections of one packet identifier together, which may go on over any
    number of packets and share one."""

    def __init__(self):
        self.waiting: bytearray | None = None

    def lose(self) -> None:
        """What went before is incomplete."""
        self.waiting = None

    def feed(self, body: bytes, start: bool):
        """(table, body between header and checksum) of the sections that end here; None
        for a broken one."""
        if start:
            if not body or 1 + body[0] > len(body):
                self.waiting = None
                yield None
                return
            head, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if self.waiting:
                self.waiting += head
                yield from self._ready(last=True)
            self.waiting = bytearray(body)
        elif self.waiting is not None:
            self.waiting += body
        yield from self._ready()

    def _ready(self, last: bool = False):
        data = self.waiting
        while data:
            if data[0] == 0xFF:  # nothing but filling follows
                data.clear()
                break
            if len(data) < 3 or len(data) < (end := 3 + ((data[1] & 15) << 8 | data[2])):
                if last:
                    yield None
                    data.clear()
                return
            one = bytes(data[:end])
            del data[:end]
            if end < 12 or crc32_mpeg(one):
                yield None
            elif one[5] & 1:  # valid from now on
                yield one[0], one[8:-4]


def _aligned(stream: bytes, at: int) -> int:
    """The next place from which packets stand at their distance: three of them, or as
    many as are left."""
    at = stream.find(SYNC, at)
    while at >= 0:
        if all(stream[k] == SYNC for k in range(at, min(at + 2 * PACKET + 1, len(stream)), PACKET)):
            return at
        at = stream.find(SYNC, at + 1)
    return len(stream)


def parse_stream(stream: bytes) -> dict:
    """programs {number: map pid}, streams {pid: type}, packets, lost (breaks of
    continuity), errors (lost alignment, packets marked as faulty, broken sections or
    elementary packets), scrambled (packets that cannot be read), and units: (pid, pts,
    dts, random access, payload, damaged) in order of their first packets.

    A packet that repeats the one before it on its identifier byte for byte is passed
    over once.  A unit of which a packet is lost, faulty or scrambled is given as far as
    it is there and marked as damaged.
    """
    programs: dict[int, int] = {}
    kinds: dict[int, int] = {}
    of_map: dict[int, set[int]] = {}
    tables: dict[int, Sections] = {PAT_PID: Sections()}
    last: dict[int, tuple[int, bytes, bool]] = {}
    open_: dict[int, list] = {}
    units: list[tuple] = []
    n = lost = errors = scrambled = 0

    def close(pid: int) -> int:
        slot, random, parts, damaged = open_.pop(pid)
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            return 1
        length, head = pes[4] << 8 | pes[5], 9 + pes[8]
        marks = pes[7] >> 6
        pts = _ticks(pes[9:14]) if marks & 2 and len(pes) >= 14 else None
        dts = _ticks(pes[14:19]) if marks == 3 and len(pes) >= 19 else pts
        short = bool(length) and len(pes) < 6 + length
        units[slot] = (pid, pts, dts, random, pes[head : 6 + length if length else None], damaged or short)
        return int(short)

    def break_(pid: int) -> None:
        if pid in open_:
            open_[pid][3] = True
        if pid in tables:
            tables[pid].lose()

    at = 0
    while at < len(stream):
        if stream[at] != SYNC:
            errors += 1
            at = _aligned(stream, at)
            continue
        if at + PACKET > len(stream):
            errors += 1
            break
        packet, at = stream[at : at + PACKET], at + PACKET
        n += 1
        b1, flags = packet[1], packet[3]
        pid, start, body, random = (b1 & 31) << 8 | packet[2], b1 & 64, 4, False
        if b1 & 128:
            errors += 1
            break_(pid)
            last.pop(pid, None)
            continue
        if pid == NULL_PID:
            continue
        jump = False
        if flags & 32:
            length = packet[4]
            if length:
                random, jump = bool(packet[5] & 64), bool(packet[5] & 128)
            body = 5 + length
        if not flags & 16:
            continue
        if body > PACKET:
            errors += 1
            break_(pid)
            continue
        c = flags & 15
        if pid in last and not jump:
            before, same, repeated = last[pid]
            if c == before and packet == same and not repeated:
                last[pid] = c, packet, True
                continue
            if c != before + 1 & 15:
                lost += 1
                break_(pid)
        last[pid] = c, packet, False
        if flags & 192:
            scrambled += 1
            break_(pid)
            continue
        if pid in tables:
            for got in tables[pid].feed(packet[body:], bool(start)):
                if got is None:
                    errors += 1
                    continue
                table, s = got
                if pid == PAT_PID and table == 0:
                    listed = {s[i] << 8 | s[i + 1]: (s[i + 2] & 31) << 8 | s[i + 3] for i in range(0, len(s) - 3, 4)}
                    programs.update({k: v for k, v in listed.items() if k})
                    for v in programs.values():
                        tables.setdefault(v, Sections())
                elif pid != PAT_PID and table == 2 and len(s) >= 4:
                    i, found = 4 + ((s[2] & 15) << 8 | s[3]), {}
                    while i + 5 <= len(s):
                        found[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                        i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
                    for gone in of_map.get(pid, set()) - set(found):
                        kinds.pop(gone, None)
                    of_map[pid] = set(found)
                    kinds.update(found)
        elif pid in kinds:
            if start:
                if pid in open_:
                    errors += close(pid)
                open_[pid] = [len(units), random, [packet[body:]], False]
                units.append(None)
            elif pid in open_:
                open_[pid][2].append(packet[body:])
    errors += sum(close(p) for p in list(open_))
    return {"programs": programs, "streams": kinds, "packets": n, "lost": lost, "errors": errors, "scrambled": scrambled, "units": [u for u in units if u]}


UNITS = T.ArrayType(T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("pts", T.LongType()), T.StructField("dts", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("damaged", T.BooleanType())]))
PARSED = [T.StructField("packets", T.LongType()), T.StructField("lost", T.LongType()), T.StructField("errors", T.LongType()), T.StructField("scrambled", T.LongType()), T.StructField("streams", T.MapType(T.IntegerType(), T.IntegerType())), T.StructField("units", UNITS)]


def _mapped(docs: DataFrame, column: str, keep: tuple[str, ...], fields: list[T.StructField], one) -> DataFrame:
    out = T.StructType([*(docs.schema[c] for c in keep), *fields])

    def run(parts):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for p in parts:
            for at in range(0, p.num_rows, 200):
                q = p.slice(at, 200)
                rows = [one(x.as_py()) for x in q.column(len(keep))]
                made = [pa.array([r[i] for r in rows], schema.field(len(keep) + i).type) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*(q.column(i) for i in range(len(keep))), *made], schema=schema)

    return docs.select(*keep, F.col(column).alias("__media")).mapInArrow(run, out)


def parse_streams(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per stream: packets, lost, errors, scrambled, streams (pid to type) and
    units.  A null or empty stream has none of them; damaged ones are counted in
    `errors`, never raised.  Repeated rows stay."""

    def one(data):
        r = parse_stream(data or b"")
        return r["packets"], r["lost"], r["errors"], r["scrambled"], list(r["streams"].items()), [dict(zip(("pid", "pts", "dts", "random_access", "data", "damaged"), u)) for u in r["units"]]

    return _mapped(media, column, keep, PARSED, one)


def pad64(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every text, zero-padded to a positive multiple of 64 bytes, as a stream
    in column `media`.  A null counts as empty."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return _mapped(docs, text_col, keep, fields, lambda t: (len(raw := (t or "").encode()), write_stream(pad64(raw))))


def _digest(data: bytes) -> tuple:
    r = parse_stream(data)
    units = r["units"]
    payload = b"".join(u[4] for u in units)
    stamps = [u[1] for u in units if u[1] is not None]
    feature = f"programs={len(r['programs'])};streams={','.join(f'{p}:{k}' for p, k in sorted(r['streams'].items()))};packets={r['packets']};units={len(units)};lost={r['lost']};errors={r['errors']};pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''};random={sum(u[3] for u in units)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, [u[1] for u in units], [u[3] for u in units]


def stream_digests(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """store_texts() and the parse of its stored bytes in one pass per text,
    for texts whose streams need not be kept: sizes, hashes, the feature, and the units'
    timestamps and random-access marks.  A null counts as empty, equal texts give equal
    values, repeated rows stay; a text of any length is one stream."""
    fields = [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("stamps", T.ArrayType(T.LongType())), ("random_access", T.ArrayType(T.BooleanType())))]

    def one(t):
        raw = (t or "").encode()
        return (len(raw), *_digest(write_stream(pad64(raw))))

    return _mapped(docs, text_col, keep, fields, one)
