import socket
import threading
import urllib.error
import urllib.request

import pytest

from stratalog.__main__ import main, parser
from stratalog.schema import StoreConfig
from stratalog.server import MetricsServer, RespServer
from stratalog.sources import legacy
from stratalog.store import Store, WriteBatch
from stratalog.streaming.sink import live_view, write_stream


class Client:
    def __init__(self, place):
        self.socket = socket.create_connection(place, 60)
        self.stream = self.socket.makefile("rb")

    def send(self, *parts):
        self.socket.sendall(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts))
        return self.read()

    def read(self):
        head = self.stream.readline().rstrip(b"\r\n")
        kind, rest = head[:1], head[1:]
        if kind == b"$":
            return None if rest == b"-1" else self.stream.read(int(rest) + 2)[:-2]
        if kind == b"*":
            return [self.read() for _ in range(int(rest))]
        return int(rest) if kind == b":" else head


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, str(tmp_path), StoreConfig(memtable_size_threshold=1 << 20)) as out:
        yield out


def test_commands(store):
    with RespServer(store, port=0) as server:
        c = Client(server.local_addr())
        assert c.send(b"PING") == b"+PONG" and c.send(b"ping", b"hi") == b"hi" and c.send(b"ECHO", b"x") == b"x"
        assert c.send(b"SET", b"user:1", b"a") == b"+OK" and c.send(b"SET", b"user:2", b"") == b"+OK" and c.send(b"SET", b"z", b"\x00\r\n") == b"+OK"
        assert (c.send(b"GET", b"user:1"), c.send(b"GET", b"user:2"), c.send(b"GET", b"z"), c.send(b"GET", b"none")) == (b"a", b"", b"\x00\r\n", None)
        assert c.send(b"EXISTS", b"user:1", b"none", b"user:1") == 2
        assert c.send(b"KEYS", b"user:*") == [b"user:1", b"user:2"] and c.send(b"KEYS", b"z") == [b"z"] and c.send(b"KEYS", b"none") == []
        assert c.send(b"DEL", b"user:1", b"user:1", b"none") == 1 and c.send(b"GET", b"user:1") is None
        assert c.send(b"COMMAND") == []
        for bad in ((b"KEYS", b"a*b"), (b"SET", b"k"), (b"NOPE",), (b"GET",)):
            assert c.send(*bad).startswith(b"-ERR"), bad
        c.socket.sendall(b"GET z\r\n\r\n")
        assert c.read() == b"\x00\r\n" and c.read().startswith(b"-ERR")
        assert c.send(b"QUIT") == b"+OK" and c.stream.read() == b""
        broken = Client(server.local_addr())
        broken.socket.sendall(b"*1\r\n+x\r\n")
        assert broken.stream.read() == b""


def test_clients_at_once(store):
    with RespServer(store, port=0) as server:
        def work(n):
            c = Client(server.local_addr())
            for i in range(20):
                assert c.send(b"SET", b"%d:%d" % (n, i), b"v") == b"+OK"

        threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert store.scan().count() == 80 and store.current_sequence() == 80


def test_metrics_and_counters(store):
    store.put(b"a", b"1")
    store.delete(b"b")
    store.write_batch(WriteBatch().put(b"c", b"2").put(b"d", b"3"))
    store.get(b"a")
    store.scan()
    with store.snapshot():
        stats = store.stats()
        assert (stats.puts_total, stats.deletes_total, stats.batches_total, stats.gets_total, stats.scans_total, stats.sequence, stats.live_snapshots) == (1, 1, 1, 1, 1, 3, 1)
    store.flush()
    assert store.stats().total_sstables() == 1 and store.stats().total_sstable_bytes() > 0 and store.stats().flushes_total == 1
    with MetricsServer(store, port=0) as server:
        at = "http://%s:%d" % server.local_addr()
        text = urllib.request.urlopen(f"{at}/metrics").read().decode()
        assert "lsm_puts_total 1\n" in text and 'lsm_sstables{level="0"} 1\n' in text and "# TYPE lsm_sequence gauge\n" in text
        for path in ("/", "/health", "/healthz"):
            assert urllib.request.urlopen(at + path).status == 200
        for path, data, code in (("/other", None, 404), ("/metrics", b"x", 405)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(at + path, data)
            assert e.value.code == code


def test_command_line(capsys):
    assert main(["help"]) == 0 and "serve" in capsys.readouterr().out
    assert parser().parse_args(["serve", "--addr", ":7000", "-v"]).verbose
    with pytest.raises(SystemExit) as e:
        main(["nonsense"])
    assert e.value.code == 2


def test_stream_into_store(spark, store, tmp_path):
    source = tmp_path / "in"
    ops = spark.createDataFrame([(1, b"a", b"x"), (2, b"a", b"y"), (3, b"b", None)], "n long, key binary, value binary")
    for i in range(2):
        ops.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ops.schema).parquet(str(source))
        write_stream(stream, store, "s", str(tmp_path / "check"), "n").awaitTermination()
        assert store.current_sequence() == i + 1
    assert [(bytes(r.key), bytes(r.value)) for r in store.scan().collect()] == [(b"a", b"y")]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "z")], "key string, seq long, value string")
    assert sorted((r.key, r.value, r.seq) for r in live_view(log).collect()) == [("a", None, 2), ("b", "z", 3)]


# Old files


def u(n, size=4):
    return n.to_bytes(size, "little")


def entry(key, seq, value):
    return u(len(key)) + key + (b"" if seq is None else u(seq, 8)) + (u(0xFFFFFFFF) if value is None else u(len(value)) + value)


def run_file(version, blocks, flags=0):
    index = u(len(blocks)) + b"".join(u(1) + b"k" + u(sum(map(len, blocks[:i])), 8) + u(len(b)) for i, b in enumerate(blocks))
    return b"LSMT" + bytes([version, flags]) + u(3) + b"\x01\x02\x03" + u(len(index)) + index + b"".join(blocks)


def test_old_runs(spark, tmp_path):
    plain = entry(b"z", 7, b"aaaaaaaaaaaaaaaaaaaaaaaa")
    head = len(plain) - 23  # literals, then one overlapping match of 18 and the last 5 as literals
    block = u(len(plain)) + bytes([0xF0 | 14, head - 15]) + plain[:head] + u(1, 2) + bytes([0x50]) + plain[-5:]
    files = {
        "L0_2.sst": run_file(3, [entry(b"a", 5, b"new") + entry(b"a", 1, b"old"), entry(b"b", 4, None)]),
        "L1_9.sst": run_file(2, [entry(b"k", None, b"low")]),
        "L0_1.sst": u(2) + b"\x00\x00" + entry(b"k", None, b"older") + entry(b"gone", None, None),
        "L0_3.sst": u(0) + entry(b"k", None, b"newest"),
        "L2_4.sst": run_file(3, [block], flags=1),
        "L2_5.sst": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = legacy.resolved(legacy.read_runs(spark, [str(tmp_path)])).collect()
    got = {(bytes(r.key), r.seq): None if r.value is None else bytes(r.value) for r in rows}
    assert got == {(b"a", 5): b"new", (b"a", 1): b"old", (b"b", 4): None, (b"k", 0): b"newest", (b"gone", 0): None, (b"z", 7): b"a" * 24}
    for bad in (run_file(9, []), run_file(3, [entry(b"a", 1, b"x")])[:-1], run_file(3, [entry(b"a", 1 << 63, b"x")])):
        with pytest.raises(ValueError):
            list(legacy.parse_run(bad))


def test_old_logs(spark, tmp_path):
    put = lambda k, v: b"\x00" + u(len(k)) + k + u(len(v)) + v
    drop = lambda k: b"\x01" + u(len(k)) + k
    batch = b"\x02" + u(3) + put(b"c", b"1") + drop(b"a") + put(b"c", b"2")
    whole = put(b"a", b"x") + batch + drop(b"zz")
    for torn in (b"", put(b"q", b"lost")[:-2], batch[:-1]):
        at = tmp_path / f"wal{len(torn)}"
        at.write_bytes(whole + torn)
        rows = [(bytes(r.key), r.seq, None if r.value is None else bytes(r.value)) for r in legacy.read_wal(spark, str(at), 10).collect()]
        assert sorted(rows) == [(b"a", 11, b"x"), (b"a", 12, None), (b"c", 12, b"2"), (b"zz", 13, None)]
    with pytest.raises(TypeError):
        list(legacy.parse_wal(b"\x07"))
