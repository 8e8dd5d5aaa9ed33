"""Both protocols against local servers that drop connections, cut messages and break rules."""

import base64
import contextlib
import hashlib
import json
import socket
import struct
import threading

import pytest

from lodewell.sources import sockets
from lodewell.sources.landing import LandedEnvelopes, LandedFrames
from test_sources_streaming import GENESIS_TX

GREETING = b"\xff" + bytes(8) + b"\x7f\x03\x01" + b"NULL".ljust(20, b"\0") + bytes(32)
READY = b"\x05READY\x0bSocket-Type" + struct.pack(">I", 3) + b"PUB"


class Server:
    """Serves one script a connection, in order, then no more."""

    def __init__(self, *scripts):
        self.sock, self.scripts, self.seen = socket.create_server(("127.0.0.1", 0)), scripts, []
        self.port = self.sock.getsockname()[1]
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        for script in self.scripts:
            peer, _ = self.sock.accept()
            with peer, contextlib.suppress(AssertionError, OSError):  # the client may leave first
                script(peer, self.seen)
        self.sock.close()


def exactly(peer, n):
    out = b""
    while len(out) < n:
        got = peer.recv(n - len(out))
        assert got
        out += got
    return out


def zframe(body, flags=0):
    return bytes([flags | 2]) + struct.pack(">Q", len(body)) + body if len(body) > 255 else bytes([flags, len(body)]) + body


def multipart(*parts):
    return b"".join(zframe(p, i < len(parts) - 1) for i, p in enumerate(parts))


def publisher(*sent, topics=1, greeting=GREETING):
    def script(peer, seen):
        peer.sendall(greeting)
        assert exactly(peer, 64)[:1] == b"\xff"
        peer.sendall(zframe(READY, 4))
        flags, n = exactly(peer, 2)
        assert flags == 4 and exactly(peer, n).endswith(b"SUB")
        for _ in range(topics):
            flags, n = exactly(peer, 2)
            seen.append(exactly(peer, n))
        for part in sent:
            peer.sendall(part)

    return script


def wframe(body, code=1, last=True, mask=False):
    n = len(body)
    size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
    return bytes([code | (0x80 if last else 0)]) + (bytes([size[0] | 0x80]) + size[1:] + bytes(4) if mask else size) + body


def pusher(*sent, accept=True, hello=0, after=0):
    def script(peer, seen):
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            head += exactly(peer, 1)
        key = next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Sec-WebSocket-Key"))
        said = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest()) if accept else b"wrong"
        peer.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nsec-websocket-accept: " + said + b"\r\n\r\n")
        for i in range(hello + after):
            if i == hello:
                for part in sent:
                    peer.sendall(part)
            first, n = exactly(peer, 2)
            mask = exactly(peer, 4)
            assert n & 0x80
            seen.append((first & 15, bytes(b ^ mask[j & 3] for j, b in enumerate(exactly(peer, n & 127)))))
        for part in sent if not after else ():
            peer.sendall(part)

    return script


def gathered(client, n):
    """n messages over as many connections as it takes; the failures on the way."""
    out, told = [], []
    for message in sockets.lasting(client, 0.01, 0.05, lambda why, wait: told.append((why, wait))):
        out += [message] if message is not None else []
        if len(out) == n:
            return out, told


def test_subscriber_over_dropped_connections():
    big = bytes(range(256)) * 300
    cut = multipart(b"rawtx", big, b"\x02\0\0\0")
    server = Server(
        publisher(multipart(b"rawtx", b"a", b"\0\0\0\0"), multipart(b"rawtx", big, b"\1\0\0\0"), cut[:-2], topics=2),
        publisher(zframe(b"\x04PING", 4), multipart(b"rawtx", b"", b"\3\0\0\0"), topics=2),
        publisher(greeting=b"HTTP/1.1 400 ".ljust(64), topics=0),
        publisher(multipart(b"sequence", b"z", b"\4\0\0\0"), topics=2),
    )
    got, told = gathered(sockets.Subscriber(f"tcp://127.0.0.1:{server.port}", ["rawtx", "sequence"], 0.05), 4)
    assert [(m[1], m[2][0]) for m in got] == [(b"a", 0), (big, 1), (b"", 3), (b"z", 4)]
    assert server.seen == [b"\1rawtx", b"\1sequence"] * 3 and len(told) == 3
    assert told[2][1] == 2 * told[1][1]  # the failure without a message between doubles the wait


@pytest.mark.parametrize("sent", [zframe(b"x", 8), b"\x02" + struct.pack(">Q", 1 << 40), zframe(b"a", 1) + zframe(b"\x04PING", 4), b"\x01\0" * 20])
def test_subscriber_refuses_what_breaks_the_protocol(sent):
    server = Server(publisher(sent))
    with pytest.raises(sockets.Broken):
        for _ in sockets.Subscriber(f"tcp://127.0.0.1:{server.port}", ["t"], 0.05).messages():
            pass


def test_web_socket_pieces_pings_and_closes():
    long = "ä" * 40_000
    server = Server(
        pusher(wframe(b"one"), wframe(b"tw", 1, False), wframe(b"still there?", 9), wframe(b"o", 0), wframe(b"\1\2", 2), wframe(b"\x03\xe8", 8), hello=1, after=2),
        pusher(accept=False),
        pusher(wframe(long.encode()), wframe(b"half of it")[:5], hello=1),
        pusher(wframe(b"end"), hello=1),
    )
    got, told = gathered(sockets.WebSocket(f"ws://127.0.0.1:{server.port}/api?x=1", ['{"want": "blocks"}'], 0.05), 4)
    assert got == ["one", "two", long, "end"] and len(told) == 3
    assert server.seen == [(1, b'{"want": "blocks"}'), (10, b"still there?"), (8, b"\x03\xe8"), (1, b'{"want": "blocks"}'), (1, b'{"want": "blocks"}')]


@pytest.mark.parametrize("sent", [wframe(b"x", mask=True), wframe(b"x", 0), wframe(b"\xff"), wframe(b"x", 9, False), wframe(b"x", 3), wframe(b"a", 1, False) + wframe(b"b", 1)])
def test_web_socket_refuses_what_breaks_the_protocol(sent):
    server = Server(pusher(sent))
    with pytest.raises(sockets.Broken):
        for _ in sockets.WebSocket(f"ws://127.0.0.1:{server.port}", tick=0.05).messages():
            pass


def test_silence_is_asked_and_then_ends_the_connection():
    def silent(peer, seen):
        pusher()(peer, seen)
        seen.append(exactly(peer, 2)[0] & 15)
        exactly(peer, 4)
        peer.recv(1)

    server = Server(silent)
    with pytest.raises(sockets.Broken, match="ping"):
        for _ in sockets.WebSocket(f"ws://127.0.0.1:{server.port}", tick=0.02, silence=0.1).messages():
            pass
    assert server.seen == [9]


def test_landed_messages_reach_the_decoders(spark, tmp_path):
    """Every message once, in files seen whole, in order of names; what is held when the messages end is landed."""
    sent = [[b"rawtx", GENESIS_TX, struct.pack("<I", i)] for i in range(5)] + [[b"\xff", b"no topic", b""], None]
    assert sockets.land(iter(sent), str(tmp_path / "frames"), seconds=1e9, most_bytes=1500) == 5
    files = sorted((tmp_path / "frames").iterdir())
    assert len(files) > 1 and not [f for f in files if f.name.startswith(".")]
    lines = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert [base64.b64decode(x["parts"][2])[0] for x in lines] == list(range(5))
    frames = LandedFrames(str(tmp_path / "frames"), "rawtx", stream=False)
    assert sorted(r["seq"] for r in frames.frames(spark).collect()) == list(range(5)) and frames.read(spark).count() == 5
    assert sockets.land(iter(['{"block": {"id": "g"},\r\n"new": 1}', None, '{"block": {"id": "h"}}']), str(tmp_path / "texts"), seconds=0) == 2
    assert LandedEnvelopes(str(tmp_path / "texts"), stream=False).read(spark).count() == 2

    def interrupted():
        yield "a"
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sockets.land(interrupted(), str(tmp_path / "last"), seconds=1e9)
    assert [f.read_text() for f in (tmp_path / "last").iterdir()] == ["a\n"]
