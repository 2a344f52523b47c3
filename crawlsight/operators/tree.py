"""The walk through sitemap indexes, depth first, as a search engine's reader would go.

Which file is read under which parent depends on the order of a whole site's walk (a file met too deep is used up), so
each site's edges, without any file's content, are walked together in one function call; sites run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from crawlsight.sources.workers import by_name

READ, REPEAT, CYCLE, TOO_DEEP = "read", "repeat", "cycle", "too-deep"
VISITS = "site_id string, sm_order int, url string, parent string, depth int, visit string, in_robots boolean"


def walk(roots: list[tuple[str, bool]], children: dict[str, list[str]], max_depth: int) -> list[tuple]:
    """(order, url, parent, depth, visit, in_robots) of every visit. children: of the files that are indexes."""
    out: list[tuple] = []
    visited: set[str] = set()
    for root, in_robots in roots:
        stack: list[tuple[str, str, int, tuple[str, ...]]] = [(root, "", 0, ())]
        while stack:
            url, parent, depth, above = stack.pop()
            visit = READ
            if url in visited:
                visit = CYCLE if url in above else REPEAT
            elif url in children and depth >= max_depth:
                visit = TOO_DEEP
            visited.add(url)
            out.append((len(out), url, parent, depth, visit, in_robots))
            if visit == READ:
                stack += [(c, url, depth + 1, (*above, url)) for c in reversed(children.get(url, []))]
    return out


def walk_site(key, roots: pd.DataFrame, edges: pd.DataFrame, max_depth: int) -> pd.DataFrame:
    starts = [(r.url, bool(r.in_robots)) for r in roots.sort_values("root_no").itertuples()]
    children = {e.url: list(e.children) for e in edges.itertuples()}
    visits = [(key[0], *v) for v in walk(starts, children, max_depth)]
    return pd.DataFrame(visits, columns=[c.split()[0] for c in VISITS.split(", ")])


def visits(roots: DataFrame, indexes: DataFrame, max_depth: int) -> DataFrame:
    """VISITS from roots (site_id, root_no, url, in_robots) and indexes (site_id, url, children)."""
    run = by_name(walk_site, max_depth)
    return roots.groupBy("site_id").cogroup(indexes.groupBy("site_id")).applyInPandas(lambda key, r, e: run(key, r, e), VISITS)
