"""Times of the headline queries, as one JSON line: index build, batches of searches, one search, and the corpus operators that are cheap to repeat."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
#: No further query begins after so many seconds; those left out are named in the result.
LIMIT = float(os.environ.get("BENCH_SECONDS", "600"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wayfind.operators.index import build_index
    from wayfind.plans.search import search_many
    from wayfind.queries import QUERIES
    from wayfind.sources import catalogs
    from wayfind.sources.workspace import new_folder

    times: dict[str, float] = {}
    skipped, start = [], time.time()

    def timed(name, f, needed=False):
        if not needed and time.time() - start > LIMIT:
            return skipped.append(name)
        began = time.time()
        out = f()
        times[name] = round(time.time() - began, 3)
        return out

    save = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("warm_up", lambda: build_index(catalogs.generated(spark, 100)).write(new_folder(spark, "warm")), needed=True)
    built = timed("index_3000_generated", lambda: build_index(catalogs.generated(spark, 3000)).write(new_folder(spark, "index")), needed=True)
    parts = timed("index_parts", lambda: build_index(catalogs.parts(spark, SF_DIR)).write(new_folder(spark, "index")), needed=True)
    rng = random.Random(7)
    words = [r["token"] for r in built.vocabulary.orderBy("token").select("token").collect()]
    simple = [(i, " ".join(rng.choices(words, k=2))) for i in range(200)]
    composite = [(i, " ".join(rng.choices(words, k=3)) + f" over {rng.randrange(50, 300)} kw under {rng.randrange(100, 500)}k") for i in range(200)]
    named = [(i, f"model {1000 + rng.randrange(3000)}") for i in range(200)]
    for name, index, queries in (("search_200_simple", built, simple), ("search_200_named", built, named), ("search_200_composite", built, composite), ("search_1", built, simple[:1]), ("search_200_parts", parts, simple)):
        df = spark.createDataFrame(queries, "query_id long, text string")
        timed(name, lambda index=index, df=df: save(search_many(index, df)))
    for name in ("normalize_text", "document_frequency", "fuzzy_match", "term_score", "compat_rank", "latency_ring"):
        timed(name, lambda name=name: save(QUERIES[name](spark, SF_DIR)))
    try:
        from wayfind.llm.queries import QUERIES as corpus
    except ImportError:
        corpus = {}
    for name, f in corpus.items():
        timed(name, lambda f=f: save(f(spark, SF_DIR)))
    times.pop("warm_up")
    print(json.dumps({"metric": "total seconds of all queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "skipped": skipped, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
