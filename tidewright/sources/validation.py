"""Checks before anything runs: WITH options, and queries that feed each other."""

from __future__ import annotations

from tidewright.lang.lexer import DialectError

#: Known types and formats.
TYPES = ("source", "sink", "internal")
FORMATS = ("json", "csv", "bytes", "text", "parquet")
TABLES = ("inMemory", "cache", "jdbc")


def check_options(name: str, options: dict, table: bool) -> None:
    """A source or sink needs an extension; an internal stream has neither extension nor format; a cache needs its size."""
    kind = options.get("type")
    if table:
        ext = options.get("extension")
        if ext is not None and ext not in TABLES:
            raise DialectError(f"table {name}: unknown extension {ext}")
        if ext == "cache" and not str(options.get("max_size", "")).isdigit():
            raise DialectError(f"table {name}: a cache needs max_size")
        if ext == "jdbc" and "url" not in options:
            raise DialectError(f"table {name}: jdbc needs a url")
        return
    if kind is None:
        if "extension" in options:
            raise DialectError(f"stream {name}: extension needs type 'source' or 'sink'")
        return
    if kind not in TYPES:
        raise DialectError(f"stream {name}: unknown type {kind}")
    if kind == "internal" and {"extension", "format"} & set(options):
        raise DialectError(f"stream {name}: an internal stream has no extension or format")
    if kind != "internal" and "extension" not in options:
        raise DialectError(f"stream {name}: a {kind} needs an extension")
    if options.get("format", "json") not in FORMATS:
        raise DialectError(f"stream {name}: unknown format {options['format']}")


def cycles(edges: list[tuple[str, list[str]]]) -> list[str] | None:
    """A loop among targets and the sources of their queries, if there is one."""
    graph: dict[str, set[str]] = {}
    for target, froms in edges:
        for s in froms:
            graph.setdefault(s, set()).add(target)
    path: list[str] = []
    done: set[str] = set()

    def visit(n: str) -> list[str] | None:
        if n in path:
            return [*path[path.index(n) :], n]
        if n in done:
            return None
        path.append(n)
        for m in sorted(graph.get(n, ())):
            if found := visit(m):
                return found
        path.pop()
        done.add(n)
        return None

    for n in sorted(graph):
        if found := visit(n):
            return found
    return None
