"""python -m stratalog [demo | serve]"""

from __future__ import annotations

import argparse
import logging
import tempfile

from pyspark.sql import SparkSession

from stratalog.schema import StoreConfig
from stratalog.server import MetricsServer, RespServer
from stratalog.store import Store, WriteBatch


def _place(text: str) -> tuple[str, int]:
    host, _, port = text.rpartition(":")
    return host or "127.0.0.1", int(port)


def demo(spark: SparkSession) -> None:
    """Writes, snapshots, a batch, time travel and compaction on a store in a temporary folder."""
    with tempfile.TemporaryDirectory() as at, Store(spark, at) as store:
        for i in range(5):
            store.put(f"user:{i}".encode(), f"name {i}".encode())
        before = store.snapshot()
        store.delete(b"user:3")
        store.write_batch(WriteBatch().put(b"user:1", b"renamed").put(b"user:9", b"new"))
        store.flush()
        show = lambda frame: {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in frame.collect()}
        print("now:", show(store.scan_prefix(b"user:")))
        print("before:", show(store.scan_prefix(b"user:", before)))
        store.compact_now()
        print(store.stats().to_prometheus())


def serve(spark: SparkSession, args: argparse.Namespace) -> None:
    with Store(spark, args.data, StoreConfig(verbose=args.verbose)) as store:
        server = RespServer(store, *_place(args.addr))
        print("serving RESP on %s:%d" % server.local_addr(), flush=True)
        if args.metrics_addr:
            print("metrics on http://%s:%d/metrics" % MetricsServer(store, *_place(args.metrics_addr)).local_addr(), flush=True)
        try:
            server.join()
        except KeyboardInterrupt:
            server.stop()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratalog")
    out.add_argument("-v", "--verbose", action="store_true")
    commands = out.add_subparsers(dest="command")
    commands.add_parser("demo", help="a scripted tour (default)")
    commands.add_parser("help", help="show this")
    s = commands.add_parser("serve", help="serve a store over the Redis protocol")
    s.add_argument("--addr", default="127.0.0.1:6379")
    s.add_argument("--data", default="./data")
    s.add_argument("--metrics-addr")
    s.add_argument("-v", "--verbose", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "help":
        parser().print_help()
        return 0
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = SparkSession.builder.appName("stratalog").getOrCreate()
    serve(spark, args) if args.command == "serve" else demo(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
