"""Command line: python -m grovelake.cli PATH VERB ..."""

import argparse
import sys

from .session import session
from .sources.encoding import formatted
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="grovelake")
    p.add_argument("path")
    p.add_argument("--namespace", default="default")
    p.add_argument("--format", default="csv", choices=["csv", "json", "table"])
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, *names in (("init",), ("set", "key", "value"), ("get", "key"), ("delete", "key"), ("list",), ("status",), ("commit", "message"), ("diff", "a", "b"), ("show", "ref"), ("history", "key"), ("keys-at", "ref"), ("merge", "source"), ("stats",), ("log",), ("branch", "name"), ("checkout", "name"), ("revert", "ref")):
        v = verbs.add_parser(verb)
        for name in names:
            v.add_argument(name)
    q = verbs.add_parser("sql")
    q.add_argument("query")
    q.add_argument("-b", "--ref", default="HEAD")
    c = verbs.add_parser("clear")
    c.add_argument("--confirm", action="store_true")
    a = p.parse_args(argv)
    store = Store(session(), a.path, create=a.verb == "init")
    ns = a.namespace

    def show(df) -> None:
        df.show((1 << 31) - 1, False) if a.format == "table" else print(formatted(df, a.format), end="")

    def text(df):
        return df.select([df[c].cast("string").alias(c) if t == "binary" else df[c] for c, t in df.dtypes])

    match a.verb:
        case "set":
            store.insert({a.key: a.value}, ns)
        case "get":
            found = store.get(a.key, ns)
            if found is None:
                return 1
            sys.stdout.buffer.write(found + b"\n")
        case "delete":
            store.delete([a.key], ns)
        case "list":
            show(text(store.list_keys(ns)))
        case "status":
            show(text(store.status(ns)))
        case "commit":
            print(store.commit(a.message))
        case "diff":
            show(text(store.diff(a.a, a.b, ns)))
        case "show":
            info, changes = store.show(a.ref, ns)
            print(info["id"], info["message"])
            show(text(changes))
        case "history":
            show(text(store.key_history(a.key, ns)))
        case "keys-at":
            show(text(store.at(a.ref, ns).orderBy("key")))
        case "merge":
            print(store.merge(a.source))
        case "stats":
            print(store.stats(ns))
        case "log":
            print(*(f"{c['id']} {c['ts']} {c['message']}" for c in store.log()), sep="\n")
        case "branch":
            store.branch(a.name)
        case "checkout":
            store.checkout(a.name)
        case "revert":
            print(store.revert(a.ref, ns))
        case "sql":
            show(store.sql(a.query, a.ref))
        case "clear":
            store.clear(a.confirm)
    return 0


if __name__ == "__main__":
    sys.exit(main())
