"""python -m unitquarry index|search|lookup|versions|reset|vacuum|bench|compare STORE ...: a thin command line over the engine."""

from __future__ import annotations

import argparse

from unitquarry.engine import Engine
from unitquarry.functions.embedding import HashingEmbedder
from unitquarry.session import local_session

#: Verbs, what they need besides the store, and what they may have.
VERBS = {
    "index": (["--path", "--library", "--version"], ["--max-chunks"]),
    "search": (["text"], ["--library", "--version", "--top-k"]),
    "lookup": (["text"], ["--library", "--version"]),
    "versions": ([], []),
    "reset": (["--library", "--to"], ["--version"]),
    "vacuum": (["--to"], []),
    "bench": (["--library"], ["--version", "--times"]),
    "compare": (["text", "--library", "--older", "--newer"], ["--top-k"]),
}
NUMBERS = {"--max-chunks": None, "--top-k": 5, "--times": 20}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="unitquarry")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, (needed, allowed) in VERBS.items():
        v = verbs.add_parser(verb)
        v.add_argument("store")
        for name in needed:
            v.add_argument(name, **({"required": True} if name.startswith("-") else {}))
        for name in allowed:
            v.add_argument(name, **({"type": int, "default": NUMBERS[name]} if name in NUMBERS else {}))
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.verb in ("search", "compare") and a.top_k < 1:
        p.error("--top-k must be 1 or more")
    spark = local_session()
    engine = Engine(spark, a.store, HashingEmbedder())
    if a.verb in ("search", "lookup"):
        asked = spark.createDataFrame([("1", a.text, a.library, a.version)], "query_id string, text string, library string, version string")
    if a.verb == "index":
        engine.index(a.path, a.library, a.version, most=a.max_chunks)
    elif a.verb == "versions":
        engine.versions().orderBy("library", "version").show(1000, False)
    elif a.verb == "search":
        print(engine.report(asked, k=a.top_k).first().report)
    elif a.verb == "lookup":
        engine.lookup(asked).join(engine.chunks().drop("embedding"), "id").show(10, False)
    elif a.verb == "reset":
        print(engine.reset(a.library, a.version, a.to), "chunks deleted")
    elif a.verb == "vacuum":
        engine.compact(a.to)
    elif a.verb == "bench":
        print(engine.bench(a.library, a.version, times=a.times))
    else:
        texts = spark.createDataFrame([("1", a.text)], "query_id string, text string")
        print("\n".join(r.markdown for r in engine.compare(texts, a.library, a.older, a.newer, k=a.top_k).collect()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
