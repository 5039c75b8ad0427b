"""``python -m kvspark repl|dashboard|serve <root>``: the command line, the timed one, or the HTTP server, over one table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Config, ServerConfig
from .frontend.auth import ADMIN
from .frontend.dashboard import Dashboard
from .frontend.http import Api, serve
from .frontend.repl import Repl
from .sources.store import KVTable


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kvspark", description=__doc__)
    parser.add_argument("command", choices=("repl", "dashboard", "serve"))
    parser.add_argument("root", help="address of the table")
    parser.add_argument("--memtable-max-size", type=int, default=Config.memtable_max_size)
    parser.add_argument("--skip-corrupt", action="store_true", help="open without the runs that are gone")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kvspark").getOrCreate()
    table = KVTable.open(spark, args.root, Config(memtable_max_size=args.memtable_max_size), skip_corrupt=args.skip_corrupt)
    if args.command == "repl":
        Repl(table, limit=None).run()
        return
    if args.command == "dashboard":
        Dashboard(table).run()
        return
    config = ServerConfig.from_env()
    api = Api(table, config)
    if config.auth_enabled:
        raw, _ = api.tokens.create("first", [ADMIN], config.token_expiry_days)
        print(f"admin token, shown once: {raw}")
    server = serve(api)
    print(f"listening on {config.host}:{config.port}")
    try:
        server.serve_forever()
    finally:
        table.flush()


if __name__ == "__main__":
    main()
