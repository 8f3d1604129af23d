"""Command line: ``python -m docloom ingest|search|status|mirror``.

Runs in the session ``spark-submit`` provides; without one it starts a local session.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths
from docloom.operators.delta import document_count
from docloom.operators.mirror import mirror_plan
from docloom.operators.search import SORTS
from docloom.plans.indexing import current_index, refresh_index
from docloom.plans.ingest import run_ingest
from docloom.plans.results import search_page
from docloom.session import configure
from docloom.sources import files, progress
from docloom.sources.catalog import Catalog


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docloom")
    jobs = parser.add_subparsers(dest="job", required=True)

    ingest = jobs.add_parser("ingest", help="bring catalog and index in step with the files")
    ingest.add_argument("--catalog", required=True)
    ingest.add_argument("--dir", nargs="+", required=True)
    ingest.add_argument("--force", "-f", action="store_true")
    ingest.add_argument("--backup-dir")
    ingest.add_argument(
        "--exclude-backup-ext", nargs="*", default=list(C.BACKUP_EXCLUDED_EXTENSIONS)
    )
    ingest.add_argument("--exclude-folder", nargs="*", default=[])

    search = jobs.add_parser("search", help="one page of results")
    search.add_argument("--catalog", required=True)
    search.add_argument("--sort", default="relevance", choices=SORTS)
    search.add_argument("--page", default="1")
    search.add_argument("query", nargs="+")

    status = jobs.add_parser("status", help="document count and the newest run record")
    status.add_argument("--catalog", required=True)

    mirror = jobs.add_parser("mirror", help="what a backup sync would copy and delete")
    mirror.add_argument("--source", required=True)
    mirror.add_argument("--target", required=True)
    mirror.add_argument("--strict", action="store_true")
    mirror.add_argument("--exclude-folder", nargs="*", default=list(C.MIRROR_EXCLUDED_FOLDERS))
    mirror.add_argument("--output", help="write the plan here instead of showing its counts")
    return parser


def _index_root(catalog: str) -> str:
    return f"{catalog.rstrip('/')}/index"


def _mirror_side(spark: SparkSession, root: str):
    listing = files.walk(spark, [root], names=(), parts=(), dot_folders=True)
    return listing.select(
        paths.relative_to(F.col("file_path"), F.col("root")).alias("rel_path"),
        F.col("modified_date").alias("mtime"),
        F.col("file_size").alias("bytes"),
    )


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"docloom {args.job}").getOrCreate())
    if args.job == "ingest":
        names = (*C.EXCLUDED_FOLDER_NAMES, *(n.lower() for n in args.exclude_folder))
        counters = run_ingest(
            spark, args.catalog, args.dir, args.force, args.backup_dir, args.exclude_backup_ext,
            folder_names=names,
        )
        refresh_index(Catalog(spark, args.catalog), _index_root(args.catalog))
        counters.show(truncate=False)
    elif args.job == "search":
        catalog = Catalog(spark, args.catalog)
        index = current_index(catalog, _index_root(args.catalog))
        if index is None:
            print("no index yet: run ingest first", file=sys.stderr)
            return 1
        result = search_page(catalog, index, " ".join(args.query), args.sort, args.page)
        result.summary.show(truncate=False)
        result.rows.select("rank", "title", "path", "modified", "snippet").show(C.PAGE_SIZE, 200)
    elif args.job == "status":
        catalog = Catalog(spark, args.catalog)
        document_count(catalog.read()).show()
        records = progress.read(spark, f"{args.catalog}/progress")
        progress.running(records, F.current_timestamp()).show(truncate=False)
    else:
        plan = mirror_plan(
            _mirror_side(spark, args.source),
            _mirror_side(spark, args.target),
            mirror=not args.strict,
            excluded_folders=args.exclude_folder,
        )
        if args.output:
            plan.write.parquet(args.output)
        else:
            plan.groupBy("action").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
