"""``python -m scriptoria``: compile a folder, or work on a project."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import review
from .plans import outputs, package
from .plans.project import Project, compile_batch
from .session import session
from .sources import extract


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptoria")
    commands = parser.add_subparsers(dest="command", required=True)
    compile_ = commands.add_parser("compile", help="a folder into a knowledge package")
    compile_.add_argument("source")
    compile_.add_argument("out")
    compile_.add_argument("--zip", action="store_true")
    compile_.add_argument("--batch", action="store_true", help="a package for each child folder")
    compile_.add_argument("--only", nargs="*", help="with --batch: these folders alone")
    compile_.add_argument("--debug", help="also write each document's texts, chunks and candidates here")
    tables = commands.add_parser("tables", help="documents, chunks and records of a folder as JSON and CSV")
    tables.add_argument("source")
    tables.add_argument("out")
    project = commands.add_parser("project", help="scan, review or export a workspace")
    project.add_argument("step", choices=("scan", "approve-all", "reject-duplicates", "retry", "review", "promote", "validate", "diagnostics", "history", "export"))
    project.add_argument("workspace")
    project.add_argument("--source")
    project.add_argument("--out")
    project.add_argument("--force", action="store_true")
    project.add_argument("--since", help="leave older files alone")
    project.add_argument("--strategy", default="default")
    project.add_argument("--review-id")
    for field in ("status", "title", "domain", "note"):
        project.add_argument(f"--{field}")
    args = parser.parse_args(argv)
    spark = session()
    if args.command in ("compile", "tables"):
        if args.command == "compile" and args.batch:
            compile_batch(spark, args.source, args.out, args.only, args.zip).show(truncate=False)
            return 0
        files = extract.extracted(extract.listing(spark, args.source))
        corpus = files.where("text <> ''").select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.col("corpus").alias("source_folder_name"), "document_type", "title", F.col("text").alias("raw_text"))
        if args.command == "tables":
            print(*outputs.write(corpus, args.out), sep="\n")
            return 0
        print(*package.write(package.artifacts(corpus), args.out, zipped=args.zip), sep="\n")
        if args.debug:
            print(*package.write_files(package.debug_files(corpus), args.debug), sep="\n")
        return 0
    work = Project(spark, args.workspace)
    if args.step == "scan":
        work.scan(args.source, args.force, since=args.since).show()
    elif args.step == "retry":
        work.retry(args.source, args.strategy).show()
    elif args.step == "review":
        work.update(args.review_id, args.status, args.title, args.domain, args.note).show()
    elif args.step == "promote":
        work.promote(args.review_id)
    elif args.step in ("validate", "history"):
        (work.validation() if args.step == "validate" else work.history().select("at", "kind", "summary")).show(truncate=False)
    elif args.step == "diagnostics":
        print(work.diagnostics(args.out)["corpus_metrics"])
    elif args.step == "export":
        files, messages = work.export(args.out)
        print(*files, *messages, sep="\n")
    else:
        work.review(review.approve_all if args.step == "approve-all" else review.reject_duplicates).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
