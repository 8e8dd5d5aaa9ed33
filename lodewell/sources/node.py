"""Readers of a node's JSON-RPC and of a public block interface, and a data source that scans block ranges with them.

The driver plans slices of heights; each task opens its own connection and reads its slice, so a lost task reads its
slice again. Streams follow the tip: a stream's offset holds the hashes of its last DEPTH blocks, so when the chain is
reorganised the next trigger steps back to the common ancestor and reads the new branch from there, heights that were read
before included.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TIMEOUT, MAX_BYTES, SLICE = 30.0, 10 << 20, 25
#: Hashes in a stream's offset: how far below the tip a reorganisation may reach.
DEPTH = 100
#: The names by which nodes and users call a chain.
CHAINS = {"main": "main", "mainnet": "main", "bitcoin": "main", "test": "test", "testnet": "test", "signet": "signet", "regtest": "regtest"}


class NodeError(Exception):
    """A reply that is an error, too large, or of the wrong chain."""


def checked_url(url: str) -> str:
    if urlsplit(url).scheme not in ("http", "https") or not urlsplit(url).hostname:
        raise ValueError("only http and https addresses are read")
    return url.rstrip("/")


def _body(reply, most: int) -> bytes:
    raw = reply.read(most + 1)
    if len(raw) > most:
        raise NodeError(f"a reply of more than {most} bytes")
    return raw


class Rpc:
    """JSON-RPC with a cookie file or a user and password. A refused cookie is read once more."""

    def __init__(self, url: str, cookie_file: str | None = None, user: str = "", password: str = "", timeout: float = TIMEOUT, most: int = 64 << 20) -> None:
        self.url, self.cookie_file, self.timeout, self.most = checked_url(url), cookie_file, timeout, most
        self.login = f"{user}:{password}" if user else ""

    def _login(self, again: bool = False) -> str:
        if self.cookie_file and (again or not self.login):
            with open(self.cookie_file) as f:
                self.login = f.read().strip()
        return self.login

    def call(self, method: str, *params):
        sent = json.dumps({"jsonrpc": "1.0", "id": 1, "method": method, "params": params}).encode()
        for again in (False, True):
            headers = {"Content-Type": "application/json"}
            if login := self._login(again):
                headers["Authorization"] = "Basic " + base64.b64encode(login.encode()).decode()
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, sent, headers), timeout=self.timeout) as reply:
                    found = json.loads(_body(reply, self.most))
            except urllib.error.HTTPError as e:
                if e.code == 401 and self.cookie_file and not again:
                    continue
                if e.code != 500:  # nodes answer 500 with an error object
                    raise NodeError(f"{method}: status {e.code}") from None
                found = json.loads(_body(e, self.most))
            if found.get("error"):
                raise NodeError(f"{method}: {found['error'].get('message', found['error'])}")
            return found["result"]

    def chain_info(self) -> dict:
        return self.call("getblockchaininfo")

    def network_info(self) -> dict:
        return self.call("getnetworkinfo")

    def mempool_info(self) -> dict:
        return self.call("getmempoolinfo")

    def mempool(self) -> list[str]:
        return self.call("getrawmempool")

    def block_hash(self, height: int) -> str:
        return self.call("getblockhash", height)

    def header(self, block_hash: str) -> dict:
        return self.call("getblockheader", block_hash, True)

    def block(self, block_hash: str) -> dict:
        return self.call("getblock", block_hash, 2)

    def block_bytes(self, block_hash: str) -> bytes:
        return bytes.fromhex(self.call("getblock", block_hash, 0))

    def transaction(self, txid: str) -> dict:
        return self.call("getrawtransaction", txid, True)

    def transaction_bytes(self, txid: str) -> bytes:
        return bytes.fromhex(self.call("getrawtransaction", txid, False))

    def unspent(self, txid: str, vout: int) -> dict | None:
        return self.call("gettxout", txid, vout, True)

    def chain_tips(self) -> list[dict]:
        return self.call("getchaintips")

    def tip(self) -> int:
        return self.chain_info()["blocks"]

    def raw_block(self, height: int, name: str | None = None) -> tuple[str, bytes]:
        """(hash, bytes) of the block of a height, or of the one named, which may have been replaced since."""
        name = name or self.block_hash(height)
        return name, self.block_bytes(name)

    def parent(self, block_hash: str) -> str | None:
        return self.header(block_hash).get("previousblockhash")

    def header_bytes(self, block_hash: str) -> bytes:
        return bytes.fromhex(self.call("getblockheader", block_hash, False))

    def capabilities(self, chain: str | None = None) -> dict:
        """What the node can serve; raises if it is on another chain than the one named."""
        info = self.chain_info()
        found = CHAINS.get(info["chain"], info["chain"])
        if chain is not None and CHAINS.get(chain, chain) != found:
            raise NodeError(f"the node is on {found}, not on {chain}")
        try:
            indexes = self.call("getindexinfo")
        except NodeError:
            indexes = {}
        return {
            "chain": found, "blocks": info["blocks"], "syncing": info.get("initialblockdownload", False), "pruned_below": info.get("pruneheight", 0) if info.get("pruned") else 0,
            "transaction_index": indexes.get("txindex", {}).get("synced", False), "version": self.network_info().get("version"),
        }


class Rest:
    """A public block interface. Server errors, refusals for haste and time-outs are tried again, waiting twice as long."""

    def __init__(self, url: str, timeout: float = TIMEOUT, most: int = MAX_BYTES, tries: int = 3, wait: float = 0.2) -> None:
        self.url, self.timeout, self.most, self.tries, self.wait = checked_url(url), timeout, most, tries, wait

    def get(self, path: str) -> bytes:
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(f"{self.url}/{path}", timeout=self.timeout) as reply:
                    return _body(reply, self.most)
            except urllib.error.HTTPError as e:
                if n == self.tries - 1 or e.code != 429 and e.code < 500:
                    raise NodeError(f"{path}: status {e.code}") from None
            except (TimeoutError, urllib.error.URLError) as e:
                if n == self.tries - 1:
                    raise NodeError(f"{path}: {e}") from None
            time.sleep(self.wait * 2**n)

    def json(self, path: str):
        return json.loads(self.get(path))

    def tip(self) -> int:
        return int(self.get("blocks/tip/height"))

    def tip_hash(self) -> str:
        return self.get("blocks/tip/hash").decode().strip()

    def block_hash(self, height: int) -> str:
        return self.get(f"block-height/{height}").decode().strip()

    def block(self, block_hash: str) -> dict:
        return self.json(f"block/{block_hash}")

    def block_transactions(self, block_hash: str, start: int = 0) -> list[dict]:
        return self.json(f"block/{block_hash}/txs/{start}")

    def transaction(self, txid: str) -> dict:
        return self.json(f"tx/{txid}")

    def mempool(self) -> dict:
        return self.json("mempool")

    def recent(self) -> list[dict]:
        return self.json("mempool/recent")

    def fees(self) -> dict:
        return self.json("v1/fees/recommended")

    def raw_block(self, height: int, name: str | None = None) -> tuple[str, bytes]:
        name = name or self.block_hash(height)
        return name, self.get(f"block/{name}/raw")

    def parent(self, block_hash: str) -> str | None:
        return self.block(block_hash).get("previousblockhash")

    def header_bytes(self, block_hash: str) -> bytes:
        return bytes.fromhex(self.get(f"block/{block_hash}/header").decode())


class _Slice(InputPartition):
    """Heights of a range; blocks whose hash is known are read by it, so that a slice read again gives the same."""

    def __init__(self, start: int, end: int, names: dict[int, str] | None = None) -> None:
        self.start, self.end, self.names = start, end, names or {}


def _client(options: dict) -> Rpc | Rest:
    if options.get("kind", "rpc") == "rest":
        return Rest(options["url"])
    return Rpc(options["url"], options.get("cookie"), options.get("user", ""), options.get("password", ""))


def _rows(options: dict, part: _Slice) -> Iterator[tuple]:
    client, heads = _client(options), options.get("part") == "header"
    for height in range(part.start, part.end + 1):
        if heads:
            name = part.names.get(height) or client.block_hash(height)
            body = client.header_bytes(name)
        else:
            name, body = client.raw_block(height, part.names.get(height))
        yield height, name, bytearray(body)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Slice]:
        start, end, size = int(self.options["start"]), int(self.options["end"]), int(self.options.get("slice", SLICE))
        return [_Slice(a, min(a + size - 1, end)) for a in range(start, end + 1, size)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return _rows(self.options, partition)


def branch_point(old: dict[int, str], new: dict[int, str], at_height) -> int:
    """The greatest height at which both chains have the same block; below the lowest remembered one if there is none.

    old and new are hashes by height; at_height gives the new chain's hash where new does not reach down far enough.
    """
    lowest, highest = min(new), max(new)
    for height in sorted(old, reverse=True):
        if height <= highest and old[height] == (new[height] if height >= lowest else at_height(height)):
            return height
    return min(old) - 1


class _TipReader(DataSourceStreamReader):
    """From the height ``start`` (or the tip at the beginning) on. The driver asks for hashes only; tasks read slices of blocks.

    An offset is {"next": height after the tip, "hashes": the last DEPTH hashes, lowest first}.
    """

    def __init__(self, options: dict) -> None:
        self.options, self.seen = options, {}
        self.depth, self.start = int(options.get("depth", DEPTH)), options.get("start")

    def initialOffset(self) -> dict:
        return {"next": int(self.start) if self.start is not None else _client(self.options).tip(), "hashes": []}

    def latestOffset(self) -> dict:
        """The tip now: its hash, then parents until a block that is remembered, so that all hashes are of one chain."""
        client = _client(self.options)
        tip = client.tip()
        if self.start is not None and tip < int(self.start):
            return {"next": int(self.start), "hashes": []}
        name, found, height = client.block_hash(tip), {}, tip
        while name and height > tip - self.depth and self.seen.get(height) != name:
            found[height] = name
            name, height = client.parent(name) if height else None, height - 1
        found |= {h: x for h, x in self.seen.items() if tip - self.depth < h <= height}
        self.seen = found
        return {"next": tip + 1, "hashes": [found[h] for h in sorted(found)]}

    @staticmethod
    def _by_height(offset: dict) -> dict[int, str]:
        names = offset.get("hashes", [])
        return dict(enumerate(names, offset["next"] - len(names)))

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        old, new, size = self._by_height(start), self._by_height(end), int(self.options.get("slice", SLICE))
        first = branch_point(old, new, _client(self.options).block_hash) + 1 if old and new else start["next"]
        return [_Slice(a, b, {h: new[h] for h in range(a, b + 1) if h in new}) for a in range(first, end["next"], size) for b in [min(a + size, end["next"]) - 1]]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    """spark.read.format("lodewell_blocks"): height, block_hash and the raw block. Options: url, kind (rpc or rest), part (block or header), start, end, slice, depth, cookie, user, password."""

    @classmethod
    def name(cls) -> str:
        return "lodewell_blocks"

    def schema(self) -> str:
        return "height bigint, block_hash string, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TipReader(dict(self.options))
