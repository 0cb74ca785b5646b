"""Which rule families look at which input, and what a cheap prefilter would miss."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import any_of
from tracesieve.operators import scans

KINDS = ("USER_SOURCE", "COMPILER_OUTPUT", "AI_RESPONSE", "USER_HINT", "PATCH", "HTTP_REQUEST", "MODEL_FILE", "DATASET_ENTRY")

# fixed values: cheap signals of the execution and resource families
EXEC_SIGNALS = ("system", "exec", "popen", "fork", "spawn", "asm", "dl", "Library", "GetProc", "socket", "getaddrinfo",
                "gethostby", "inet_", "WSA", "curl_", "fopen", "freopen", "open", "stream", "filesystem", "remove",
                "unlink", "rmdir", "rename", "getenv", "_dupenv", "GetEnvironment", "##", "#define", "constructor",
                "#pragma", "#include", "CreateProcess", "ShellExecute", "WinExec")
RESOURCE_SIGNALS = ("#include", "#define", "while", "for", "do", "[", "vector", "new", "malloc", "calloc", "resize")
SECRET_SIGNALS = ("AIza", "gsk_", "sk-", "gh", "AKIA", "xox", "PRIVATE KEY", "eyJ", "=", ":")


@dataclass(frozen=True)
class Family:
    """A named rule family: the kinds it handles and a superset prefilter on (text, purpose)."""
    name: str
    kinds: tuple[str, ...]
    quick: Callable[[Column, Column, Column], Column]
    optional: bool = False


def _always(t: Column, p: Column, k: Column) -> Column:
    return F.lit(True)


def _output_signal(t: Column, p: Column, k: Column) -> Column:
    strange = t.rlike(r"[^\x00-\x7F]")
    shown = t.rlike(r"[<\x1B\r\x08]") | strange | t.rlike(scans.SPOOFED) | t.rlike(scans.SCHEME)
    return F.when(k == "USER_SOURCE", strange).otherwise(shown)


REGISTRY: tuple[Family, ...] = (
    Family("execution", ("USER_SOURCE",), lambda t, p, k: any_of(t, EXEC_SIGNALS)),
    Family("weakness", ("USER_SOURCE",), _always, optional=True),
    Family("resource", ("USER_SOURCE",), lambda t, p, k: any_of(t, RESOURCE_SIGNALS) | t.rlike("[^\n]{100001}") | (F.octet_length(t) > 2 * 1024 * 1024)),
    Family("output", ("COMPILER_OUTPUT", "AI_RESPONSE", "USER_SOURCE"), _output_signal),
    Family("request", ("HTTP_REQUEST",), _always),
    Family("secret", ("USER_SOURCE", "COMPILER_OUTPUT", "AI_RESPONSE", "USER_HINT"), lambda t, p, k: any_of(t, SECRET_SIGNALS)),
    Family("integrity", ("DATASET_ENTRY", "MODEL_FILE"),
           lambda t, p, k: ((k == "DATASET_ENTRY") & (p == "dataset")) | ((k == "MODEL_FILE") & (p == "model_load"))),
    Family("prompt", ("USER_SOURCE", "COMPILER_OUTPUT", "USER_HINT"), lambda t, p, k: (p == "ai_send") & scans.has_injection(t)),
    Family("patch", ("PATCH",), lambda t, p, k: p == "patch"),
    Family("audit", ("PATCH",), lambda t, p, k: p == "patch"),
)


def register(families: Sequence[Family], new: Family) -> tuple[Family, ...]:
    """Registry with ``new`` added, or replacing the family of the same name in place."""
    if any(f.name == new.name for f in families):
        return tuple(new if f.name == new.name else f for f in families)
    return (*families, new)


def with_quick(families: Sequence[Family], name: str, quick) -> tuple[Family, ...]:
    return tuple(replace(f, quick=quick) if f.name == name else f for f in families)


def route(df: DataFrame, text: str, kind: str, purpose: str, families: Sequence[Family] = REGISTRY,
          include_optional: bool = True) -> DataFrame:
    """Adds ``candidates`` and ``routed`` (arrays of family names) to each input; no join."""
    t, k, p = F.col(text), F.col(kind), F.col(purpose)
    use = [f for f in families if include_optional or not f.optional]
    handles = [k.isin(*f.kinds) for f in use]
    return df.withColumns({
        "candidates": F.array_compact(F.array(*[F.when(h, F.lit(f.name)) for h, f in zip(handles, use)])),
        "routed": F.array_compact(F.array(*[F.when(h & F.coalesce(f.quick(t, p, k), F.lit(False)), F.lit(f.name))
                                            for h, f in zip(handles, use)]))})


def routing_ratio(routed: DataFrame, by: str) -> DataFrame:
    """Mean share of candidate families that ran; 1.0 where there is no candidate."""
    share = F.when(F.size("candidates") > 0, F.size("routed") / F.size("candidates")).otherwise(F.lit(1.0))
    return routed.groupBy(by).agg(F.count("*").alias("inputs"), F.avg(share).alias("ratio"))


def routing_misses(routed: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs with an (agent, category) pair that the full scan finds and the routed scan does not.

    ``findings`` are those of the full scan; the routed ones are those whose agent ran.
    """
    pairs = findings.groupBy(*keys, "agent", "category").agg(F.count("*").alias("__n"))
    ran = routed.select(*keys, F.explode("routed").alias("agent"))
    return pairs.join(ran, [*keys, "agent"], "left_anti").select(*keys).distinct()
