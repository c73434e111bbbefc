"""Command line: ``python -m skerry index|watch|search|library ...``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skerry")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build an index from a folder of files")
    i.add_argument("config")
    i.add_argument("--library", help="SQLite file of a bibliographic library")
    w = sub.add_parser("watch", help="look at the configured folder once and bring its index up to date")
    w.add_argument("config")
    s = sub.add_parser("search", help="search an index")
    s.add_argument("folder")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid", choices=("semantic", "keyword", "hybrid"))
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--thesaurus")
    s.add_argument("--config", help="the configuration that the index was built with: its thesaurus and its embedding model")
    lib = sub.add_parser("library", help="export a library's items as JSON")
    lib.add_argument("database")
    lib.add_argument("out")
    args = p.parse_args(argv)

    from .plans.engine import Engine, SearchQuery
    from .session import get_session
    from .sources import files, library, thesaurus

    spark = get_session()
    if args.command == "watch":
        cfg = files.load_config(args.config)
        engine = Engine(spark, cfg.output_folder, **cfg.engine())
        print(engine.watch(cfg.input_folder, cfg.file_types, cfg.chunk_size, cfg.overlap))
    elif args.command == "index":
        cfg = files.load_config(args.config)
        docs = files.documents(spark, cfg.input_folder, cfg.file_types)
        database = args.library or (library.database_in(cfg.library_directory) if cfg.library_enabled else None)
        tables = library.read_sqlite(spark, database) if database else None
        if tables:
            from .operators.facets import merge_sources

            docs = merge_sources(docs, library.documents(library.items(tables)), "doc_id")
        engine = Engine(spark, cfg.output_folder, **cfg.engine())
        print(engine.ensure(docs, cfg.chunk_size, cfg.overlap), engine.status())
    elif args.command == "search":
        kind = files.load_config(args.config).engine() if args.config else {}
        if args.thesaurus:
            kind["thesaurus"] = thesaurus.load(args.thesaurus)
        engine = Engine.open(spark, args.folder, **kind)
        for row in engine.search(SearchQuery(args.query, mode=args.mode, top_k=args.top_k)).collect():
            print(f"{row['score']:.4f}  {row['path']}  {row['snippet']}")
    else:
        tables = library.read_sqlite(spark, args.database)
        if tables is None:
            print("no such library")
            return 1
        library.items(tables).write.mode("overwrite").json(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
