"""Binary messages to observations: consensus transactions and blocks by Arrow UDFs, frames and sequences by built-ins."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.sources.schemas import TX_INPUT, TX_OUTPUT

MAX_BYTES = 4_000_000


def frames(df: DataFrame, topic: str) -> DataFrame:
    """Valid multipart frames of a topic: three parts, the last a four-byte little-endian number."""
    good = (F.size("parts") == 3) & (F.col("parts")[0] == F.lit(topic).cast("binary")) & (F.octet_length(F.col("parts")[2]) == 4)
    return df.filter(good).select(F.col("parts")[1].alias("body"), little_endian(F.col("parts")[2]).alias("seq"))


def little_endian(raw: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("([0-9A-F]{2})"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)").cast("bigint")


def sequence_events(df: DataFrame) -> DataFrame:
    """Block (C, D: 33 bytes) and mempool (A, R: 41 bytes) sequence messages: hash, label, mempool_sequence."""
    label, n = F.substring("body", 33, 1).cast("string"), F.octet_length("body")
    block, pool = label.isin("C", "D") & (n == 33), label.isin("A", "R") & (n == 41)
    return df.filter(block | pool).select(F.lower(F.hex(F.substring("body", 1, 32))).alias("hash"), label.alias("label"), F.when(pool, little_endian(F.substring("body", 34, 8))).alias("mempool_sequence"))


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("truncated")
        self.at += n
        return self.raw[self.at - n : self.at]

    def int(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def size(self) -> int:
        n = self.int("B")
        return n if n < 0xFD else self.int({0xFD: "H", 0xFE: "I", 0xFF: "Q"}[n])


def _twice(raw: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(raw).digest()).digest()


#: Script shapes as (type, length, first bytes, last bytes).
SHAPES = [("p2pkh", 25, b"\x76\xa9\x14", b"\x88\xac"), ("p2sh", 23, b"\xa9\x14", b"\x87"), ("v0_p2wpkh", 22, b"\x00\x14", b""), ("v0_p2wsh", 34, b"\x00\x20", b""), ("v1_p2tr", 34, b"\x51\x20", b"")]
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_B32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def script_type(script: bytes) -> str | None:
    if script[:1] == b"\x6a":
        return "op_return"
    return next((name for name, n, a, z in SHAPES if len(script) == n and script.startswith(a) and script.endswith(z)), None)


def _base58(payload: bytes) -> str:
    raw = payload + _twice(payload)[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = _B58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def _segwit(version: int, program: bytes) -> str:
    bits = "".join(f"{b:08b}" for b in program)
    data = [version, *(int(bits[i : i + 5].ljust(5, "0"), 2) for i in range(0, len(bits), 5))]
    check = 1
    for v in [3, 3, 0, 2, 3, *data, 0, 0, 0, 0, 0, 0]:  # the prefix "bc", expanded
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    check ^= 0x2BC830A3 if version else 1
    return "bc1" + "".join(_B32[v] for v in [*data, *(check >> 5 * (5 - i) & 31 for i in range(6))])


def address(script: bytes) -> str | None:
    """The main-network address of a standard script."""
    kind = script_type(script)
    if kind == "p2pkh":
        return _base58(b"\0" + script[3:23])
    if kind == "p2sh":
        return _base58(b"\5" + script[2:22])
    return _segwit(0 if kind[1] == "0" else 1, script[2:]) if kind in ("v0_p2wpkh", "v0_p2wsh", "v1_p2tr") else None


def read_transaction(r: _Reader) -> dict:
    start = r.at
    version = r.take(4)
    marked = r.raw[r.at : r.at + 2] == b"\0\1"
    if marked:
        r.take(2)
    body = r.at
    inputs, outputs = [], []
    for _ in range(r.size()):
        prev, vout = r.take(32), r.int("I")
        r.take(r.size())
        null = prev == bytes(32) and vout == 0xFFFFFFFF
        inputs.append({"txid": prev[::-1].hex(), "vout": vout, "sequence": r.int("I"), "is_coinbase": null})
    for n in range(r.size()):
        value, script = r.int("q"), None
        script = r.take(r.size())
        outputs.append({"value_sats": value, "n": n, "script_pubkey_type": script_type(script), "address": address(script), "scriptpubkey_hex": script.hex()})
    core = r.raw[body : r.at]
    if marked:
        for _ in inputs:
            for _ in range(r.size()):
                r.take(r.size())
    lock = r.take(4)
    stripped = version + core + lock
    size = r.at - start
    weight = 3 * len(stripped) + size
    return {
        "txid": _twice(stripped)[::-1].hex(), "size": size, "weight": weight, "vsize": (weight + 3) // 4, "inputs": inputs, "outputs": outputs, "is_rbf": any(i["sequence"] < 0xFFFFFFFE for i in inputs),
        "input_count": len(inputs), "output_count": len(outputs), "total_output_sats": sum(o["value_sats"] for o in outputs), "total_input_sats": 0, "fee_sats": 0,
    }


def decode_transaction(raw: bytes) -> dict:
    r = _Reader(raw)
    tx = read_transaction(r)
    if r.at != len(raw):
        raise ValueError("trailing bytes")
    return tx


def decode_block(raw: bytes) -> dict:
    """A block's header, transactions, and the height its first input states (0 if it states none)."""
    r = _Reader(raw)
    header = r.take(80)
    at = r.at
    txs = [read_transaction(r) for _ in range(r.size())]
    probe = _Reader(raw)
    probe.at = at
    probe.size()
    probe.take(4)
    if raw[probe.at : probe.at + 2] == b"\0\1":
        probe.take(2)
    probe.size(), probe.take(36)
    script = probe.take(probe.size())
    n = script[0] if script else 0
    height = int.from_bytes(script[1 : 1 + n], "little") if 1 <= n <= 8 and header[:4] >= b"\2\0\0\0" and int.from_bytes(header[:4], "little") >= 2 else 0
    return {"block_hash": _twice(header)[::-1].hex(), "previous_block_hash": header[4:36][::-1].hex(), "time": int.from_bytes(header[68:72], "little"), "height": height, "size_bytes": len(raw), "weight": sum(t["weight"] for t in txs) + 4 * (len(raw) - sum(t["size"] for t in txs)), "tx_count": len(txs), "transactions": txs}


TX = f"struct<txid: string, size: bigint, weight: bigint, vsize: bigint, inputs: array<{TX_INPUT}>, outputs: array<{TX_OUTPUT}>, is_rbf: boolean, input_count: bigint, output_count: bigint, total_output_sats: bigint, total_input_sats: bigint, fee_sats: bigint>"
BLOCK = f"struct<block_hash: string, previous_block_hash: string, time: bigint, height: bigint, size_bytes: bigint, weight: bigint, tx_count: bigint, transactions: array<{TX}>>"


def _udf(decode, ddl: str, most: int):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(ddl)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for raw in column.to_pylist():
            try:
                out.append(decode(raw) if raw is not None and len(raw) <= most else None)
            except (ValueError, struct.error, KeyError, IndexError):
                out.append(None)
        return pa.array(out, to_arrow_type(kind))

    return F.arrow_udf(run, kind)


def transactions(df: DataFrame, column: str = "body", most: int = MAX_BYTES) -> DataFrame:
    """Decoded transactions; bodies that do not parse or are too large are left out."""
    return df.withColumn("tx", _udf(decode_transaction, TX, most)(column)).filter("tx IS NOT NULL").select("tx.*")


def blocks(df: DataFrame, column: str = "body", most: int = MAX_BYTES, stated: str | None = None) -> DataFrame:
    """Decoded blocks; bodies that do not parse or are too large are left out. ``stated`` names a column that has the height."""
    out = df.withColumn("b", _udf(decode_block, BLOCK, most)(column)).filter("b IS NOT NULL")
    out = out.select("b.*") if stated is None else out.withColumn("b", F.col("b").withField("height", F.coalesce(F.col(stated), F.col("b.height")))).select("b.*")
    return out.withColumn("timestamp", F.timestamp_seconds("time")).drop("time")


def headers(df: DataFrame, column: str = "body") -> DataFrame:
    """df with previous_block_hash and timestamp from the 80 bytes that a block begins with, by built-in functions alone."""
    turned = lambda first, n: F.hex(F.concat(*[F.substring(column, first + n - 1 - i, 1) for i in range(n)]))
    whole = df.filter(F.length(column) >= 80)
    return whole.withColumns({"previous_block_hash": F.lower(turned(5, 32)), "timestamp": F.timestamp_seconds(F.conv(turned(69, 4), 16, 10).cast("bigint"))})
