"""``python -m fathomline``: from documents to references, indices, memory and diffusion, over a folder of Parquet tables.

A store is a folder: ``documents``, ``references``, ``deduplicated``, ``indices``, ``industries``, ``events``, ``portfolio``,
``diffusion``, ``curves``. Each command reads what an earlier one wrote and replaces its own tables.
"""

from __future__ import annotations

import argparse
import json

KEYS = ("company", "year", "doc_type", "doc_id")
SETTINGS = {"store": "store", "taxonomy": "ai", "separator": "\f", "threshold": 0.6, "formats": ["csv"], "first_year": None, "last_year": None}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomline")
    p.add_argument("--config", help="JSON file of settings; options go before it")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    detect = sub.add_parser("detect", help="references of a taxonomy in a Parquet table of documents (doc_id, text)")
    detect.add_argument("documents")
    detect.add_argument("taxonomy", help="folder of the taxonomy's CSV sheets, or the name of a built-in one")
    detect.add_argument("--hard", help="pattern of hard triggers; else those of the taxonomy's subject")
    detect.add_argument("--soft", help="pattern of soft triggers; else those of the taxonomy's subject")
    template = sub.add_parser("template", help="write the sheets of an empty taxonomy")
    template.add_argument("folder")
    ingest = sub.add_parser("ingest", help="documents to references; documents of the store that were read before are left out")
    ingest.add_argument("documents", help="Parquet table with doc_id, text and, if known, company, year, doc_type, industry")
    ingest.add_argument("--again", action="store_true", help="read all documents again")
    sub.add_parser("dedupe", help="references without repeats within a document")
    sentiment = sub.add_parser("sentiment", help="sentiment of references that have none yet")
    sentiment.add_argument("--governance", action="store_true", help="talk of rules and safety is never negative")
    sub.add_parser("index", help="indices of company-years and industries")
    sub.add_parser("memory", help="adoption events and portfolios")
    sub.add_parser("diffusion", help="points of technologies by year, and their curves")
    export = sub.add_parser("export", help="the flat sheet of references")
    export.add_argument("folder")
    export.add_argument("--format", action="append", dest="formats", choices=("csv", "json", "xlsx", "parquet"))
    export.add_argument("--raw", action="store_true", help="with repeats")
    sub.add_parser("status", help="rows of the store's tables")
    sub.add_parser("config", help="the settings in effect")
    for x in (ingest, export, *(sub.choices[c] for c in ("dedupe", "sentiment", "index", "memory", "diffusion", "status", "config"))):
        x.add_argument("--store", help="folder of the store")
    for x in (ingest, export):
        x.add_argument("--taxonomy", help="folder of the taxonomy's CSV sheets, or the name of a built-in one")
    for x in (run, detect):
        x.add_argument("--out", help="Parquet table to write; else the first rows are shown")
    return p


def taxonomy_of(name: str):
    """A built-in taxonomy by its name, else one from a folder of sheets; patterns that do not compile go."""
    from fathomline.operators import builtin, taxonomy

    known = {t.name: t for t in (builtin.AI, builtin.DIGITAL)}
    found, bad = (known[name] if name in known else taxonomy.read_sheets(name)).checked()
    for p in bad:
        print(f"left out, does not compile: {p}")
    return found


class Store:
    """The tables of a folder, on any file system that Spark reaches."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str):
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def need(self, name: str, command: str):
        out = self.read(name)
        if out is None:
            raise SystemExit(f"{self.folder} has no {name}: run {command} first")
        return out

    def write(self, name: str, df) -> None:
        """Replaces a table, also one that ``df`` reads: the new one is written beside the old one first."""
        new = f"{self.folder}/.{name}"
        df.write.mode("overwrite").parquet(new)
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(new).getFileSystem(conf)
        fs.delete(path(f"{self.folder}/{name}"), True)
        fs.rename(path(new), path(f"{self.folder}/{name}"))


def ingest(store: Store, documents: str, taxonomy, separator: str, again: bool) -> None:
    from pyspark.sql import functions as F

    from fathomline.functions import text as tx
    from fathomline.operators import references, relational, windows

    docs = store.spark.read.parquet(documents)
    keys = [c for c in KEYS if c in docs.columns]
    old, refs = (None, None) if again else (store.read("documents"), store.read("references"))
    fresh = docs if old is None else relational.unprocessed(docs, old, "doc_id")
    pages = windows.pages(fresh.select(*keys, "text"), separator=separator)
    found = references.detect(pages, taxonomy, keys)
    facts = fresh.select(*keys, *[c for c in ("industry",) if c in docs.columns], F.size(F.split(F.coalesce("text", F.lit("")), separator)).alias("n_pages"), tx.word_count(F.col("text")).alias("n_words"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise("valid").alias("text_status"))
    store.write("references", found if refs is None else refs.unionByName(found, allowMissingColumns=True))
    store.write("documents", facts if old is None else old.unionByName(facts, allowMissingColumns=True))


def dedupe(store: Store) -> None:
    from fathomline.operators import references

    refs = store.need("references", "ingest")
    store.write("deduplicated", references.deduplicated(refs, [c for c in KEYS if c in refs.columns]))


def sentiment(store: Store, governance: bool) -> None:
    from fathomline.operators import references, vocabulary

    store.write("references", references.with_sentiment(store.need("references", "ingest"), governance=vocabulary.GOVERNANCE if governance else None))


def units(store: Store):
    """References as memory and diffusion read them, told apart by a number."""
    from pyspark.sql import functions as F

    refs = store.read("deduplicated")
    refs = store.need("references", "ingest") if refs is None else refs
    if not {"company", "year"} <= set(refs.columns):
        raise SystemExit("documents have no company and year")
    return refs.withColumn("ref_id", F.xxhash64("company", "year", "doc_id", "page", "window_no")).withColumn("product", F.lit("")).withColumn("vendor", F.lit(""))


def indices(store: Store) -> None:
    from pyspark.sql import functions as F

    from fathomline.operators import index, vocabulary

    docs = store.need("documents", "ingest")
    per = docs.groupBy("company", "year").agg(F.sum("n_pages").alias("year_pages"), *([F.first("industry", True).alias("industry")] if "industry" in docs.columns else []))
    refs = units(store).withColumn("said", F.concat_ws(" ", "text", "context")).drop("text").withColumnRenamed("said", "text").join(per.select("company", "year", "year_pages"), ["company", "year"], "left")
    one = index.composite(index.factors(refs, F.max("year_pages"), vocabulary.FORWARD_LOOKING, vocabulary.SALIENCE))
    store.write("indices", index.ranked(one))
    if "industry" in docs.columns:
        store.write("industries", index.by_industry(one.join(per.select("company", "year", "industry"), ["company", "year"])))


def memories(store: Store) -> None:
    from pyspark.sql import functions as F

    from fathomline.operators import memory

    refs = units(store)
    years = refs.select("year").distinct()
    both = None
    for d, unit in (("A", "category_a"), ("B", "category_b")):
        part = memory.events(refs.where(F.col(unit) != ""), [unit]).select("company", "year", F.lit(d).alias("dimension"), F.col(unit).alias("category"), "event_type")
        both = part if both is None else both.unionByName(part)
    store.write("events", both)
    store.write("portfolio", memory.portfolio(refs.where("category_b <> ''"), ["category_b", "product", "vendor"], years))


def diffused(store: Store, first: int | None, last: int | None) -> None:
    from pyspark.sql import functions as F

    from fathomline.operators import diffusion

    rows = diffusion.yearly(store.need("portfolio", "memory"))
    span = rows.agg(F.min("year"), F.max("year"), F.count_distinct("company")).first()
    if span[0] is None:
        raise SystemExit("the portfolio is empty")
    used = diffusion.adopters(diffusion.adoptions(rows), last or span[1])
    scored = diffusion.scores(used.where(F.col("year") >= (first or span[0])), "category_b")
    store.write("diffusion", scored)
    store.write("curves", diffusion.curves(scored, "category_b", F.lit(float(span[2]))))


def export(store: Store, folder: str, taxonomy, formats: list[str], raw: bool) -> list[str]:
    from fathomline.sources import writers

    refs = store.need("references", "ingest") if raw else store.need("deduplicated", "dedupe")
    sheet = writers.reference_sheet(refs, [d for d, _ in taxonomy.dimensions])
    return writers.export_all(sheet, folder, "references" if raw else "references_dedup", formats)


TABLES = ("documents", "references", "deduplicated", "indices", "industries", "events", "portfolio", "diffusion", "curves")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from fathomline.plans import catalogue
    from fathomline.sources.readers import config

    given = {k: v for k, v in vars(args).items() if k in SETTINGS}
    set_ = config(SETTINGS, args.config, **given)
    if args.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.command == "config":
        print(json.dumps(set_, indent=2, ensure_ascii=False))
        return 0
    if args.command == "template":
        from fathomline.sources.writers import taxonomy_template

        print("\n".join(taxonomy_template(args.folder)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("fathomline").getOrCreate()
    if args.command in ("run", "detect"):
        if args.command == "run":
            out = catalogue.QUERIES[args.name](spark, args.tables)
        else:
            import dataclasses

            from fathomline.operators import references, windows

            t = dataclasses.replace(taxonomy_of(args.taxonomy), **{k: v for k, v in (("hard_triggers", args.hard), ("soft_triggers", args.soft)) if v})
            pages = windows.pages(spark.read.parquet(args.documents).select("doc_id", "text"), separator=set_["separator"])
            out = references.with_sentiment(references.deduplicated(references.detect(pages, t, ["doc_id"]), ["doc_id"]))
        if args.out:
            out.write.mode("overwrite").parquet(args.out)
        else:
            out.show(20, False)
        return 0
    store = Store(spark, set_["store"])
    if args.command == "ingest":
        ingest(store, args.documents, taxonomy_of(set_["taxonomy"]), set_["separator"], args.again)
    elif args.command == "dedupe":
        dedupe(store)
    elif args.command == "sentiment":
        sentiment(store, args.governance)
    elif args.command == "index":
        indices(store)
    elif args.command == "memory":
        memories(store)
    elif args.command == "diffusion":
        diffused(store, set_["first_year"], set_["last_year"])
    elif args.command == "export":
        print("\n".join(export(store, args.folder, taxonomy_of(set_["taxonomy"]), set_["formats"], args.raw)))
    if args.command != "export":
        for name in TABLES:
            if (t := store.read(name)) is not None:
                print(f"{name}: {t.count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
