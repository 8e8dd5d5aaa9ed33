"""Sockets that push: subscriptions over ZMTP 3.0 and text messages over RFC 6455, landed as files that Spark follows.

One process holds a connection and lands what comes (``python -m lodewell listen``); Spark's streams of ``landing`` do the
rest. A file is written under a hidden name, synced and renamed, so a stream sees whole files only, and they stay until its
checkpoint has them. A dropped connection is opened again after a wait that doubles; a message cut short by it is left out,
and one that was landed is not landed again. Publishers repeat nothing, so what they send while no connection stands is
lost; the numbers in the frames tell how much (``chain.sequence_states``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

#: Bytes of one message at most, and parts of one multipart message.
MOST_BYTES, MOST_PARTS = 8_000_000, 16
#: Fixed value: what RFC 6455 appends to a key before it is hashed.
_ACCEPT = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class Broken(Exception):
    """The peer broke the protocol; the connection cannot go on."""


class _Wire:
    """A connection that gives whole reads: a wait that ends before the first byte is no loss, one within a message is."""

    def __init__(self, sock: socket.socket, tick: float) -> None:
        self.sock, self.rest = sock, b""
        sock.settimeout(tick)

    def take(self, n: int, patience: int = 30) -> bytes:
        if n > MOST_BYTES:
            raise Broken(f"{n} bytes announced")
        parts, have = [self.rest[:n]], len(self.rest[:n])
        self.rest = self.rest[n:]
        while have < n:
            try:
                got = self.sock.recv(min(n - have, 1 << 16))
            except TimeoutError:
                patience -= 1
                if patience <= 0:
                    raise Broken("nothing more of a message came") from None
                continue
            if not got:
                raise ConnectionError("closed by the peer")
            parts.append(got)
            have += len(got)
        return b"".join(parts)

    def waits(self) -> bool:
        """Whether a tick passed without a byte."""
        if self.rest:
            return False
        try:
            self.rest = self.sock.recv(1 << 16)
        except TimeoutError:
            return True
        if not self.rest:
            raise ConnectionError("closed by the peer")
        return False

    def close(self) -> None:
        self.sock.close()


class Subscriber:
    """A ZMTP 3.0 subscriber without security. ``messages`` gives lists of parts, and None when a tick passed without any."""

    def __init__(self, address: str, topics: list[str], tick: float = 1.0) -> None:
        at = urlsplit(address)
        if at.scheme != "tcp" or not at.hostname or not at.port:
            raise ValueError("an address is tcp://host:port")
        self.at, self.topics, self.tick = (at.hostname, at.port), topics, tick

    def messages(self) -> Iterator[list[bytes] | None]:
        wire = _Wire(socket.create_connection(self.at, timeout=10), self.tick)
        try:
            wire.sock.sendall(b"\xff" + bytes(8) + b"\x7f" + b"\x03\x00" + b"NULL".ljust(20, b"\0") + bytes(32))
            hello = wire.take(64)
            if hello[:1] != b"\xff" or hello[9:10] != b"\x7f" or hello[10] < 3:
                raise Broken("no ZMTP 3 peer")
            if hello[12:32].rstrip(b"\0") != b"NULL":
                raise Broken("the peer asks for a security mechanism")
            mine = b"\x05READY\x0bSocket-Type" + struct.pack(">I", 3) + b"SUB"
            wire.sock.sendall(b"\x04" + bytes([len(mine)]) + mine)
            flags, body = self._frame(wire)
            if not flags & 4 or not body.startswith(b"\x05READY"):
                raise Broken("the peer is not ready")
            for topic in self.topics:
                name = b"\x01" + topic.encode()
                wire.sock.sendall(b"\x00" + bytes([len(name)]) + name)
            while True:
                if wire.waits():
                    yield None
                    continue
                parts, size = [], 0
                while True:
                    flags, body = self._frame(wire)
                    if flags & 4:
                        if parts:
                            raise Broken("a command within a message")
                        break
                    parts.append(body)
                    size += len(body)
                    if size > MOST_BYTES or len(parts) > MOST_PARTS:
                        raise Broken("a message over the bound")
                    if not flags & 1:
                        yield parts
                        break
        finally:
            wire.close()

    @staticmethod
    def _frame(wire: _Wire) -> tuple[int, bytes]:
        flags = wire.take(1)[0]
        if flags & ~7:
            raise Broken("reserved flags")
        return flags, wire.take(struct.unpack(">Q", wire.take(8))[0] if flags & 2 else wire.take(1)[0])


class WebSocket:
    """Text messages of a web socket, after ``hello`` texts were sent. None when a tick passed; silence is answered by a ping."""

    def __init__(self, url: str, hello: list[str] | None = None, tick: float = 1.0, silence: float = 30.0) -> None:
        self.url, self.hello, self.tick, self.silence = urlsplit(url), hello or [], tick, silence
        if self.url.scheme not in ("ws", "wss") or not self.url.hostname:
            raise ValueError("a url is ws://host or wss://host")

    def _open(self) -> _Wire:
        secure = self.url.scheme == "wss"
        port = self.url.port or (443 if secure else 80)
        sock = socket.create_connection((self.url.hostname, port), timeout=10)
        try:
            if secure:
                sock = ssl.create_default_context().wrap_socket(sock, server_hostname=self.url.hostname)
            key = base64.b64encode(os.urandom(16))
            path = (self.url.path or "/") + (f"?{self.url.query}" if self.url.query else "")
            asked = [f"GET {path} HTTP/1.1", f"Host: {self.url.hostname}:{port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key.decode()}", "Sec-WebSocket-Version: 13"]
            sock.sendall(("\r\n".join(asked) + "\r\n\r\n").encode())
            wire, head = _Wire(sock, self.tick), b""
            while not head.endswith(b"\r\n\r\n"):
                head += wire.take(1)
                if len(head) > 16_384:
                    raise Broken("a head without an end")
            status, *lines = head.decode("latin-1").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            if status.split(" ")[1:2] != ["101"] or fields.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1(key + _ACCEPT).digest()).decode():
                raise Broken(f"no upgrade: {status}")
            return wire
        except BaseException:
            sock.close()
            raise

    @staticmethod
    def _send(wire: _Wire, code: int, body: bytes) -> None:
        n, mask = len(body), os.urandom(4)
        size = bytes([0x80 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 1 << 16 else b"\xff" + struct.pack(">Q", n)
        wire.sock.sendall(bytes([0x80 | code]) + size + mask + bytes(b ^ mask[i & 3] for i, b in enumerate(body)))

    @staticmethod
    def _frame(wire: _Wire) -> tuple[bool, int, bytes]:
        first, second = wire.take(2)
        if first & 0x70 or second & 0x80:
            raise Broken("reserved bits, or a masked frame from a server")
        n, code = second & 0x7F, first & 15
        if code >= 8 and (n > 125 or not first & 0x80):
            raise Broken("a control frame that is long or in pieces")
        n = struct.unpack(">H", wire.take(2))[0] if n == 126 else struct.unpack(">Q", wire.take(8))[0] if n == 127 else n
        return bool(first & 0x80), code, wire.take(n)

    def messages(self) -> Iterator[str | None]:
        wire = self._open()
        try:
            for text in self.hello:
                self._send(wire, 1, text.encode())
            heard, asked, parts, kind = time.monotonic(), False, [], 0
            while True:
                if wire.waits():
                    quiet = time.monotonic() - heard
                    if quiet > 2 * self.silence:
                        raise Broken("no answer to a ping")
                    if quiet > self.silence and not asked:
                        self._send(wire, 9, b"")
                        asked = True
                    yield None
                    continue
                last, code, body = self._frame(wire)
                heard, asked = time.monotonic(), False
                if code == 8:
                    self._send(wire, 8, body[:2])
                    raise ConnectionError("closed by the peer")
                if code == 9:
                    self._send(wire, 10, body)
                if code >= 8:
                    continue
                if (code == 0) != bool(parts) or code > 2:
                    raise Broken("pieces out of order")
                kind = code or kind
                parts.append(body)
                if sum(map(len, parts)) > MOST_BYTES or len(parts) > 10_000:
                    raise Broken("a message over the bound")
                if last:
                    whole, parts = b"".join(parts), []
                    if kind == 1:
                        try:
                            yield whole.decode()
                        except UnicodeDecodeError:
                            raise Broken("text that is not UTF-8") from None
        finally:
            wire.close()


def lasting(client: Subscriber | WebSocket, first: float = 1.0, most: float = 60.0, told: Callable[[str, float], None] = lambda why, wait: None) -> Iterator:
    """Messages of one connection after the other. A wait doubles with each failure and starts anew after a message.

    None is given while waiting too, so what has been gathered can be landed.
    """
    wait = first
    while True:
        try:
            for message in client.messages():
                if message is not None:
                    wait = first
                yield message
        except (OSError, Broken) as e:
            told(f"{type(e).__name__}: {e}", wait)
        until = time.monotonic() + wait
        wait = min(2 * wait, most)
        while time.monotonic() < until:
            yield None
            time.sleep(max(0.0, min(1.0, until - time.monotonic())))


def line(message: list[bytes] | str) -> str | None:
    """A message as the landed streams read it: a JSON line of topic and parts, or the text itself in one line."""
    if isinstance(message, str):
        return message.replace("\r", " ").replace("\n", " ")
    try:
        topic = message[0].decode()
    except UnicodeDecodeError:
        return None
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return json.dumps({"topic": topic, "parts": [base64.b64encode(p).decode() for p in message], "received_at": stamp})


def land(messages: Iterator, folder: str, seconds: float = 5.0, most_bytes: int = 64_000_000, stop: Callable[[], bool] = lambda: False) -> int:
    """Land messages in a folder that Spark can read too, a file each ``seconds`` or ``most_bytes``; how many were landed.

    Names grow with time, so streams read files in the order in which they came. What has been gathered is landed when
    ``stop`` says so, when the messages end and when the process is interrupted.
    """
    os.makedirs(folder, exist_ok=True)
    held, size, since, landed = [], 0, 0.0, 0

    def flush() -> None:
        nonlocal held, size, landed
        if not held:
            return
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        hidden = os.path.join(folder, f".{name}")
        with open(hidden, "w", encoding="utf-8") as out:
            out.write("\n".join(held) + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.rename(hidden, os.path.join(folder, f"{name}.jsonl"))
        landed += len(held)
        held, size = [], 0

    try:
        for message in messages:
            text = None if message is None else line(message)
            if text is not None:
                since = since if held else time.monotonic()
                held.append(text)
                size += len(text)
            if held and (size >= most_bytes or time.monotonic() - since >= seconds):
                flush()
            if stop():
                break
    finally:
        flush()
    return landed
