"""Registry of model backends: pandas UDFs by name, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BACKENDS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, reduce: Callable[[Column], Column]) -> None:
    """Name a function from a text column to a text column, for example a wrapped model."""
    _BACKENDS[name] = reduce


def backend(name: str) -> Callable[[Column], Column]:
    if name not in _BACKENDS:
        raise KeyError(f"no backend {name!r}; known: {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name]


def from_pandas(make: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A backend of a Python function that ``make`` builds once for each task."""
    def reduce(body: Column) -> Column:
        def run(batches):
            f = make()
            for batch in batches:
                yield batch.map(f)

        run.__annotations__ = {"batches": "Iterator[pd.Series]", "return": "Iterator[pd.Series]"}
        return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(body)

    return reduce


register("digest", lambda body: F.concat(F.lit("summary "), F.md5(body)))
register("first_line", from_pandas(lambda: lambda text: text.split("\n", 1)[0]))
