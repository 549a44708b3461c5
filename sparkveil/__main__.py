"""Command line: mask, unmask and wipe one text. Exit codes: 0 done, 1 placeholders are left, 2 can't."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession


def _arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sparkveil")
    sub = p.add_subparsers(dest="what", required=True)
    m, u, w = (sub.add_parser(n) for n in ("mask", "unmask", "wipe"))
    for x in (m, u):
        x.add_argument("input", nargs="?")
        x.add_argument("--out")
    m.add_argument("--clients")
    m.add_argument("--no-ner", action="store_true")
    m.add_argument("--address", action="store_true")
    m.add_argument("--llm", action="store_true")
    m.add_argument("--html")
    m.add_argument("--encrypt", action="store_true")
    for x in (m, u, w):
        x.add_argument("--mapping", default=os.path.join(".session", "mapping.json"))
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .plans import pipeline
    from .sources import documents, mappings, review

    a = _arguments(args)
    if a.what == "wipe":
        mappings.forget(a.mapping)
        return 0
    spark = spark or SparkSession.builder.appName("sparkveil").getOrCreate()
    passphrase = os.environ.get("SPARKVEIL_PASSPHRASE")
    text = documents.read_input(spark, a.input).collect()[0].text
    if a.what == "mask":
        if a.encrypt and not passphrase:
            print("SPARKVEIL_PASSPHRASE is needed to encrypt", file=sys.stderr)
            return 2
        plan = pipeline.build(spark, clients=a.clients, use_ner=not a.no_ner, use_address=a.address, use_llm=a.llm)
        from pyspark.sql import functions as F

        from .operators.mask import report_text

        masked = pipeline.mask(spark.createDataFrame([(text,)], "text string"), plan)
        html = review.page(F.col("text"), F.col("masked_text"), F.col("report"))
        row = masked.select("masked_text", "report", report_text(F.col("report")).alias("said"), html.alias("html")).collect()[0]
        documents.write_output(row.masked_text, a.out)
        mappings.save(spark, {r.token: r.original for r in row.report}, a.mapping, passphrase if a.encrypt else None)
        if a.html:
            review.write_page(a.html, row.html)
        print(row.said, file=sys.stderr)
        return 0
    try:
        held = mappings.load(spark, a.mapping, passphrase)
    except (OSError, ValueError) as e:
        print(f"the mapping can't be read: {type(e).__name__}", file=sys.stderr)
        return 2
    got = pipeline.unmask_text(spark, text, held)
    documents.write_output(got["text"], a.out)
    for x in got["warnings"]:
        print(x, file=sys.stderr)
    return 1 if got["unresolved"] else 0


if __name__ == "__main__":
    sys.exit(main())
