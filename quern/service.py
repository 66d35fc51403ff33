"""The engine: five verbs over a semantic model, within a scope that must be chosen."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError, ScopeError
from quern.operators import compare as comparing
from quern.operators import fetch as fetching
from quern.operators import measure as measuring
from quern.operators import select as selecting
from quern.operators.relation import TENANT_GLOBAL, Reader, Relation, ScopeFor
from quern.operators.relevance import Embed, citation, cohort, split_topk, with_vectors
from quern.plans import describe as describing
from quern.plans.graph import resolve
from quern.plans.language import Filter, Leaf, leaves, normalize
from quern.plans.model import SemanticModel


class Unscoped:
    def __repr__(self) -> str:
        return "UNSCOPED"


UNSCOPED = Unscoped()


def tenant_scope(tenant: Callable[[], Any], column: Mapping[str, str] | str, tenant_global: Sequence[str] = ()) -> ScopeFor:
    """A scope read anew by every query. ``column`` names the tenant column, or one for each entity that has it.

    No tenant, or an entity that is neither covered nor declared global, gives no scope: the engine then refuses.
    """

    def scope(entity: str) -> Any:
        if entity in tenant_global:
            return TENANT_GLOBAL
        own = column if isinstance(column, str) else column.get(entity)
        value = tenant()
        return None if value is None or own is None else {own: value}

    return scope


class Engine:
    """One requester's view. ``scope``: UNSCOPED, or a function from entity name to a filter, TENANT_GLOBAL or None."""

    def __init__(self, spark: SparkSession, model: SemanticModel, *, scope: ScopeFor | Unscoped | None = None, embed: Embed | None = None, viewing_scope: str | None = None, expose: Mapping[str, Sequence[str]] | None = None):
        """``expose``: the native columns of each entity that results and catalogs show; None shows all."""
        if scope is None:
            raise ScopeError("scope: choose one, or UNSCOPED")
        self.model, self.embed, self.viewing_scope, self.expose = model, embed, viewing_scope, expose
        self.reader = Reader(spark, model, None if isinstance(scope, Unscoped) else scope)

    def describe(self, entity: str | None = None) -> dict[str, Any]:
        found = describing.describe(self.model, entity)
        for d in [found] if entity is not None else found.values():
            d["fields"] = [f for f in d["fields"] if f["source"] != "native" or self._shows(d["entity"], f["name"])]
        return found

    def _shows(self, entity: str, column: str) -> bool:
        return self.expose is None or column == self.model.entity(entity).pk or column in self.expose.get(entity, ())

    def describe_conformed_dimensions(self, entity: str) -> list[dict[str, Any]]:
        return describing.describe_dimensions(self.model, entity)

    def describe_measures(self, entity: str) -> list[dict[str, Any]]:
        return describing.describe_measures(self.model, entity)

    def describe_metrics(self) -> list[dict[str, Any]]:
        return describing.describe_metrics(self.model)

    def diagnose(self) -> list[dict[str, str]]:
        return describing.diagnose(self.model)

    def select(self, entity: str, **options: Any) -> selecting.SelectResult:
        out = selecting.select(self.reader, entity, embed=self.embed, **options)
        if self.expose is not None:
            out.df = out.df.select(*(F.col(f"`{c}`") for c in out.df.columns if self._public(entity, c)))
        return out

    def _public(self, entity: str, path: str) -> bool:
        """Whether a column of a result may be shown: native ones by their entity's list, all others as they are declared."""
        try:
            target = resolve(self.model, entity, path)
        except InvalidQueryError:  # a rank, a snippet or a window
            return True
        return target.kind not in ("native", "json") or self._shows(target.entity.name, target.name)

    def select_many(self, requests: Sequence[Mapping[str, Any]]) -> list[tuple[list[Any], int]]:
        """Ids and totals of several selects, run side by side."""
        results = selecting.select_many(self.reader, requests, self.embed)
        with ThreadPoolExecutor(max_workers=min(8, max(1, len(results)))) as pool:
            return list(pool.map(lambda r: (r.ids(), r.total()), results))

    def fetch(self, entity: str, ids: Sequence[Any] | DataFrame, **options: Any) -> DataFrame:
        rows = fetching.fetch(self.reader, entity, ids, embed=self.embed, **options)
        if self.expose is None:
            return rows
        allowed = {e.name: [e.pk, *self.expose.get(e.name, ()), *(c.name for c in e.computed), *(e.eav.fields if e.eav else ())] for e in self.model.entities.values()}
        return fetching.project(rows, self.model.entity(entity), allowed, self.model.entities)

    def measure(self, entity: str, **options: Any) -> measuring.MeasureResult:
        self.model.entity(entity)
        boundary = bool((options.pop("citation", None) or {}).get("boundary"))
        tree = with_vectors(normalize(options.pop("filter", None)), self.embed)
        for leg in [x for x in options.get("measures", ()) if isinstance(x, Mapping)]:
            if any(x.op == "relevant" for x in leaves(normalize(leg.get("where")))):
                raise InvalidQueryError("relevant: stands in the filter, not in a measure's where")
        top, rest = split_topk(tree)
        group_by = options.get("group_by", ())
        # a cohort's cut follows scope alone, not the other filters; by group it defaults to the first key
        cohorts = [(leaf, cohort(self.reader, entity, leaf, per=leaf.value.get("per") or (group_by[0] if group_by and leaf.value.get("per") is not False else None), whole_days=True)) for leaf in top]

        def apply(relation: Relation, source: str) -> Filter:
            for leaf, c in cohorts:
                relation.within(self._hops(entity, source, leaf), c.keys())
            return rest

        out = measuring.measure(self.reader, entity, filter=rest, cohorts=apply, **options)
        cited = [x for x in leaves(tree) if x.op in ("sim_gte", "sim_topk")]
        if cited:
            own = next((c for leaf, c in cohorts if leaf is cited[0]), None)
            out.cite = lambda: citation(self.reader, own or cohort(self.reader, entity, cited[0], per=None, whole_days=True), boundary=boundary)
        return out

    def _hops(self, root: str, source: str, leaf: Leaf) -> tuple:
        """Way from a source to the rows that the leaf is about."""
        target = resolve(self.model, root, leaf.on)
        return target.hops if source == root else measuring.carried(self.model, root, source, leaf.on).hops

    def compare(self, entity: str, **options: Any) -> comparing.CompareResult:
        return comparing.compare(lambda **o: self.measure(entity, **o), plain=lambda m: comparing.plain_measure(self.model, entity, m), **options)


class Surface:
    """Engines by requester. A request may narrow itself to what one user sees: ``scope={"as": "user", "user": ...}``.

    ``scope_for(requester, user)`` gives the scope, ``resolve_user(requester, value)`` the user that an id or address means, or
    None; users that aren't known are refused rather than the scope widened.
    """

    VERBS = ("select", "fetch", "measure", "compare")

    def __init__(self, spark: SparkSession, model: SemanticModel, *, requester: Callable[[], str], scope_for: Callable[[str, str | None], ScopeFor | Unscoped], resolve_user: Callable[[str, str], str | None] | None = None, list_users: Callable[[str], Sequence[Any]] | None = None, viewing_scope_for: Callable[[str, str | None], str] | None = None, **options: Any):
        self.spark, self.model, self.options = spark, model, options
        self.requester, self.scope_for, self.resolve_user, self.users, self.viewing_scope_for = requester, scope_for, resolve_user, list_users, viewing_scope_for
        self.engines: dict[tuple[str, str | None, str], Engine] = {}

    def list_users(self) -> list[Any]:
        """Users that the requester may narrow a request to."""
        return list(self.users(self.requester())) if self.users else []

    def engine(self, scope: Mapping[str, Any] | None = None) -> Engine:
        requester, user = self.requester(), None
        if (scope or {}).get("as", "org") not in ("org", "user"):
            raise InvalidQueryError("scope: as is org or user")
        if scope and scope.get("as") == "user":
            if not scope.get("user"):
                raise InvalidQueryError("scope: as a user needs the user")
            user = self.resolve_user(requester, scope["user"]) if self.resolve_user else None
            if user is None:
                raise InvalidQueryError(f"scope: {scope['user']} is no known user")
        viewing = self.viewing_scope_for(requester, user) if self.viewing_scope_for else "personal"
        key = (requester, user, viewing)
        if key not in self.engines:
            self.engines[key] = Engine(self.spark, self.model, scope=self.scope_for(requester, user), viewing_scope=viewing, **self.options)
        return self.engines[key]

    def run(self, verb: str, *args: Any, scope: Mapping[str, Any] | None = None, **options: Any) -> Any:
        if verb not in self.VERBS:
            raise InvalidQueryError(f"surface: unknown verb {verb}")
        return getattr(self.engine(scope), verb)(*args, **options)
