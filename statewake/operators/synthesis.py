"""From extracted facts to a model: ordered check chains, rejections, transitions, and unfolded resources.

Facts are tables by service, as ``sources.extraction`` reads them:

- endpoints(service, handler, verb, path, handler_type, validated, body_type, response_body)
- checks(service, id, expression, place)
- outcomes(service, seq, endpoint_id, status, discriminator, checks array, sense); an endpoint_id is
  ``handler::VERB``, and a discriminator ``declared`` marks what is declared and not constructed
- members(service, type_name, name, constraints array)
- mappings(service, exception, status, advice, response_body)

Everything lands at Quarantine. What cannot be told stays as a finding with its reason; nothing is
guessed. Null guards, expressions and statuses say nothing; repeated facts count once; empty tables
give empty results. The checks of one endpoint are one array: a handler's code bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.functions.scores import resource_of
from statewake.operators import graph

SERVICE = "service"
#: Joins within a service take rows that are dealt by service as they are.
DEALT = "spark.sql.requireAllClusterKeysForCoPartition"
CHAIN = [SERVICE, "endpoint_id"]

# The exception of failed bean validation, the conditions that stand for an accepted
# request, the state of a call without a route, and the verbs that create
VALIDATION_EXCEPTION = "MethodArgumentNotValidException"
PAYLOAD_VALID, REQUEST_ACCEPTED = "payload_valid", "request_accepted"
READY, QUARANTINE, IMPLEMENTED = "Ready", "Quarantine", "implemented"
UNRESOLVED_PATH = "__unresolved__"
CREATING = ("POST", "PUT")

#: What runs before every check in a handler's body.
VALIDATION_ID, VALIDATION_PLACE = "dim-validation", 0


# evaluation order
def chains(checks: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """The checks of each endpoint in the order that they are evaluated: service, endpoint_id, chain, reason, unordered.

    checks(service, endpoint_id, id, expression, place): a lower place comes first, a null place says
    nothing. precedence(service, endpoint_id, first, later) are further facts. Layers are taken off this
    partial order one by one; the chain is in order if each has one check. reason is ``cycle`` if checks
    are left over, ``tie`` if a layer has several, else null; unordered has the ids in question.
    """
    row = F.struct("id", "expression", F.col("place").cast("long").alias("place"))
    rows = checks.groupBy(*CHAIN).agg(F.array_sort(F.collect_set(row)).alias("_left"))
    no_edges = F.array().cast("array<struct<first:string,later:string>>")
    if precedence is not None:
        edges = precedence.groupBy(*CHAIN).agg(F.collect_set(F.struct(F.col("first").cast("string").alias("first"), F.col("later").cast("string").alias("later"))).alias("_edges"))
        rows = rows.join(edges, CHAIN, "left").withColumn("_edges", F.coalesce("_edges", no_edges))
    else:
        rows = rows.withColumn("_edges", no_edges)
    ids = "array<string>"
    # Kahn's layers; a check is free if nothing that is left comes before it
    free = "filter(s.left, x -> not exists(s.left, y -> coalesce(y.place < x.place, false) or exists(_edges, e -> e.first = cast(y.id as string) and e.later = cast(x.id as string))))"
    start = f"struct(_left as left, filter(_left, x -> false) as done, cast(array() as {ids}) as tied)"
    step = f"""transform(array({free}), f -> struct(
        filter(s.left, x -> not exists(f, y -> y.id <=> x.id)) as left, concat(s.done, f) as done,
        if(size(f) > 1, concat(s.tied, transform(f, y -> cast(y.id as string))), s.tied) as tied))[0]"""
    rows = rows.withColumn("_s", F.expr(f"aggregate(sequence(1, greatest(size(_left), 1)), {start}, (s, i) -> {step})"))
    left = F.transform("_s.left", lambda x: x["id"].cast("string"))
    reason = F.when(F.size("_s.left") > 0, "cycle").when(F.size("_s.tied") > 0, "tie")
    unordered = F.array_join(F.array_sort(F.when(F.size("_s.left") > 0, left).otherwise(F.col("_s.tied"))), ",")
    return rows.select(*CHAIN, F.concat("_s.done", "_s.left").alias("chain"), reason.alias("reason"), unordered.alias("unordered"))


def chain_guards(chain: DataFrame) -> DataFrame:
    """What holds where a check of a chain in order fails, and where all pass: service, endpoint_id, id (null: all pass), guard. Later checks are not named: they are never evaluated."""
    words = F.transform("chain", lambda x: x.expression)
    n = F.size("chain")
    failing = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.get("chain", k - 1)["id"].cast("string").alias("id"), F.array_join(F.concat(F.slice(words, F.lit(1), k - 1), F.array(F.concat(F.lit("NOT ("), F.get(words, k - 1), F.lit(")")))), " AND ").alias("guard")))
    success = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.array_join(words, " AND ").alias("guard")))
    return chain.where("reason is null").select(*CHAIN, F.explode(F.concat(failing, success)).alias("_g")).select(*CHAIN, "_g.*")


def chain_cost(chain: DataFrame, variants: DataFrame) -> DataFrame:
    """Cases that guard coverage of a chain needs: bounded (one check varied at a time), product, and exploded where the order is unresolved, so that no bound holds. variants(service, endpoint_id, id, n); fewer than two count as two."""
    n = variants.groupBy(*CHAIN, F.col("id").cast("string").alias("id")).agg(F.max("n").cast("long").alias("n")).groupBy(*CHAIN).agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("_n"))
    rows = chain.join(n, CHAIN, "left")
    counts = F.transform("chain", lambda x: F.greatest(F.coalesce(F.try_element_at("_n", x["id"].cast("string")), F.lit(2)), F.lit(2)))
    rows = rows.withColumn("_c", counts)
    product = F.aggregate("_c", F.lit(1.0), lambda a, x: a * x)
    exploded = F.col("reason").isNotNull()
    bounded = F.aggregate("_c", F.lit(1).cast("long"), lambda a, x: a + x - 1)
    return rows.select(*CHAIN, F.when(exploded, product).otherwise(bounded.cast("double")).alias("bounded"), product.alias("product"), exploded.alias("exploded"), "reason")


# names
def _label(text: Column, pattern: str) -> Column:
    parts = F.filter(F.split(text, pattern), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def resource_label(resource: Column) -> Column:
    """All segments of a resource's route as one name; ``Resource`` for none."""
    label = _label(F.coalesce(resource, F.lit("")), r"[/_-]")
    return F.when(label == "", "Resource").otherwise(label)


def resource_noun(resource: Column) -> Column:
    """The segments of a resource's route as words."""
    return F.array_join(F.filter(F.split(F.lower(resource), r"[/_-]"), lambda p: p != ""), " ")


def _route(trigger: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(trigger, F.lit("")), r"^\S* (.*)$", 1))


def start_state(trigger: Column) -> Column:
    """The state that a call starts from: its resource's own."""
    path = _route(trigger)
    return F.when((path == "") | (resource_of(path) == "/") | F.contains(path, F.lit(UNRESOLVED_PATH)), READY).otherwise(resource_label(resource_of(path)))


def _started(rows: DataFrame) -> DataFrame:
    """Rows with start_state of their trigger in _source, each part of it evaluated once."""
    rows = rows.withColumn("_at", _route(F.col("trigger"))).withColumn("_of", F.when((F.col("_at") != "") & ~F.contains("_at", F.lit(UNRESOLVED_PATH)), resource_of(F.col("_at"))))
    return rows.withColumn("_name", F.when(F.col("_of") != "/", _label(F.col("_of"), r"[/_-]"))).withColumn("_source", F.when(F.col("_name").isNull(), READY).when(F.col("_name") == "", "Resource").otherwise(F.col("_name"))).drop("_at", "_of", "_name")


def outcome_state(verb: Column, path: Column, status: Column, discriminator: Column) -> Column:
    """The state that an outcome leads to, named after route and status; after the discriminator where no route is known."""
    return _named_state(F.coalesce(_words_of(verb, path), _label(F.coalesce(discriminator, F.lit("")), _NO_NAME)), status)


_NO_NAME = "[^A-Za-z0-9]+"


def _words_of(verb: Column, path: Column) -> Column:
    """The words of a route as one name; null for none."""
    return F.when(path.isNotNull(), _label(F.concat_ws(" ", F.lower(F.coalesce(verb, F.lit(""))), path), _NO_NAME))


def _named_state(label: Column, status: Column) -> Column:
    return F.concat(F.when(label == "", "Outcome").otherwise(label), F.coalesce(status, F.lit(0)).cast("string"))


def carried_body(status: Column, declared: Column) -> Column:
    """The body that an outcome has: none with 204, 304 and 1xx."""
    return F.when(status.isin(204, 304) | status.between(100, 199), "").otherwise(F.coalesce(declared, F.lit("")))


# rejections
def _success(status: Column) -> Column:
    return status.between(200, 299)


def _simple(name: Column) -> Column:
    return F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1)


def _tail(endpoint_id: str = "endpoint_id") -> Column:
    return F.substring_index(endpoint_id, "::", -1)


def _keyed(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the handler in their endpoint_id."""
    before = F.expr("substr(endpoint_id, 1, length(endpoint_id) - length(substring_index(endpoint_id, '::', -1)) - 2)")
    return outcomes.withColumn("handler", F.when(F.contains("endpoint_id", F.lit("::")), before).otherwise(F.col("endpoint_id")))


def exception_statuses(mappings: DataFrame) -> DataFrame:
    """service, exception, status; null where mappings disagree, since their precedence cannot be told."""
    return mappings.groupBy(SERVICE, "exception").agg(F.min("status").alias("_low"), F.max("status").alias("_high")).select(SERVICE, "exception", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("status"))


def _validated(endpoints: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """Endpoints, dealt by service, with no_validation, validation_status and constraints."""
    constrained = members.where("size(constraints) > 0").repartition(SERVICE).groupBy(SERVICE, _simple(F.col("type_name")).alias("_type")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("constraints")))).alias("_constraints"))
    raised = exception_statuses(mappings.where(F.col("exception") == VALIDATION_EXCEPTION).repartition(SERVICE)).select(SERVICE, F.col("status").alias("_status"))
    rows = endpoints.repartition(SERVICE).withColumn("_type", _simple(F.col("body_type"))).join(constrained, [SERVICE, "_type"], "left").join(raised, SERVICE, "left")
    reason = (
        F.when(~F.coalesce("validated", F.lit(False)), "not validated").when(F.coalesce("body_type", F.lit("")) == "", "no body").when(F.col("_constraints").isNull(), "no constraints").when(F.col("_status").isNull(), "no status of the exception")
    )
    return rows.withColumn("no_validation", reason).withColumns({"validation_status": F.when(F.col("no_validation").isNull(), F.col("_status")), "constraints": F.when(F.col("no_validation").isNull(), F.col("_constraints"))})


def payload_validation(endpoints: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """For each endpoint the status of a payload that fails validation and its constraints, or why nothing can be said: the first link of the chain that is missing."""
    return _validated(endpoints, members, mappings).select(SERVICE, "handler", "no_validation", "validation_status", "constraints")


def _handlers(endpoints: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row a handler, dealt by service: its routes with the names that follow from them, what is known of their validation, and what the exception handlers of its own controller say."""
    own = mappings.where(~_success(F.col("status"))).repartition(SERVICE).groupBy(SERVICE, F.col("advice").alias("handler_type")).agg(F.collect_set(F.struct("status", "exception", "response_body")).alias("_own"))
    rows = _validated(endpoints, members, mappings).join(own, [SERVICE, "handler_type"], "left")
    rows = _started(rows.withColumn("trigger", F.when(F.col("path").isNotNull(), F.concat_ws(" ", "verb", "path"))))
    route = F.struct("verb", "path", F.col("response_body").alias("body"), "trigger", _words_of(F.col("verb"), F.col("path")).alias("words"), F.col("_source").alias("source"))
    said = F.struct("no_validation", "validation_status", "constraints")
    return rows.groupBy(SERVICE, "handler").agg(F.collect_list(route).alias("_routes"), F.collect_list(said).alias("_said"), F.array_distinct(F.flatten(F.collect_list("_own"))).alias("_own"))


def _declined(handlers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every endpoint of an outcome with each of its routes: whether its code constructs an outcome, and the statuses of rejections that it only declares."""
    says = F.coalesce(F.col("discriminator") == "declared", F.lit(False))
    ends = _keyed(outcomes).groupBy(*CHAIN).agg(F.collect_set(F.when(says & ~_success(F.col("status")), F.col("status"))).alias("_declared"), F.collect_set(F.when(~says, F.col("status"))).alias("_built"), F.bool_or(~says).alias("_builds"))
    rows = _keyed(ends.where("service is not null and endpoint_id is not null")).repartition(SERVICE).join(handlers, [SERVICE, "handler"], "left")
    own = lambda c: F.coalesce(F.col(f"_own.{c}"), F.array().cast(f"array<{handlers.schema['_own'].dataType.elementType[c].dataType.simpleString()}>"))
    rows = rows.withColumns({
        "_open": F.sort_array(F.array_except(F.array_union("_declared", own("status")), "_built")),
        "_causes": F.sort_array(F.array_except(F.array_compact(own("exception")), F.array(F.lit(VALIDATION_EXCEPTION)))), "_bodies": F.array_except(F.array_compact(own("response_body")), F.array(F.lit(""))),
    })
    rows = rows.select(*CHAIN, "handler", "_builds", "_open", "_causes", "_bodies", "_said", F.explode_outer("_routes").alias("_route")).select("*", F.explode_outer("_said").alias("_v"))
    return rows.select(
        *CHAIN, "handler", "_builds", F.get("_open", F.lit(0)).alias("status"), F.array_join(F.col("_open").cast("array<string>"), ",").alias("_all"), F.size("_open").alias("_n"), "_causes", "_bodies",
        F.col("_route").isNotNull().alias("_known"), F.col("_route.verb").alias("verb"), F.col("_route.path").alias("path"), "_v.no_validation", "_v.validation_status", "_v.constraints",
    )


def rejections(endpoints: DataFrame, outcomes: DataFrame, members: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The declared rejection of each endpoint that its code does not construct, and findings(service, subject, kind, detail).

    Declared are statuses of declared outcomes and of exception handlers in the endpoint's own
    controller. Of several the lowest is taken: nothing orders them. Its condition is that the payload
    is invalid where every link is there, that the one exception of the controller is thrown, or that
    the request is not accepted. Handlers for the whole estate say nothing about an endpoint.
    """
    return _rejections(_declined(_handlers(endpoints, members, mappings), outcomes), endpoints, mappings)


def _rejections(declined: DataFrame, endpoints: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rejections by what _declined found."""
    rows = declined.where("_n > 0")
    estate = mappings.where(~_success(F.col("status"))).repartition(SERVICE).join(endpoints.select(SERVICE, F.col("handler_type").alias("advice")).distinct(), [SERVICE, "advice"], "left_anti").distinct()
    valid = F.coalesce(F.col("validation_status") == F.col("status"), F.lit(False))
    thrown = ~valid & (F.size("_causes") == 1)
    expression = F.when(valid, PAYLOAD_VALID).when(thrown, F.concat(F.get("_causes", F.lit(0)), F.lit(" is thrown"))).otherwise(REQUEST_ACCEPTED)
    not_ = lambda x: F.concat(F.lit("NOT ("), x, F.lit(")"))
    found = rows.where("_known").select(
        *CHAIN, "handler", "verb", "path", "status", F.when(thrown, not_(expression)).otherwise(expression).alias("success_guard"), F.when(thrown, expression).otherwise(not_(expression)).alias("rejection_guard"),
        F.when(valid, "derived-validation").when(thrown, "advice-scope").otherwise("declared").alias("claim"), F.when(valid, F.col("constraints")).alias("constraints"),
        F.when(F.size("_bodies") == 1, F.get("_bodies", F.lit(0))).otherwise("").alias("response_body"),
    )
    vague = F.coalesce("no_validation", F.concat(F.lit("the exception has status "), F.col("validation_status").cast("string")))
    finding = lambda df, subject, kind, detail: df.select(SERVICE, subject.alias("subject"), F.lit(kind).alias("kind"), detail.alias("detail"))
    at = F.col("endpoint_id")
    findings = (
        finding(rows.where("_n > 1"), at, "several-rejections", F.col("_all"))
        .unionAll(finding(rows.where("not _known"), at, "endpoint-unknown", F.col("status").cast("string")))
        .unionAll(finding(rows.where(F.col("_known") & ~valid), at, "no-validation", vague))
        .unionAll(finding(rows.where(F.col("_known") & ~valid & (F.size("_causes") > 1)), at, "several-causes", F.array_join("_causes", ",")))
        .unionAll(finding(estate, F.col("exception"), "estate-wide", F.concat_ws(" ", F.col("status").cast("string"), "advice")))
        .unionAll(finding(exception_statuses(mappings).where("status is null"), F.col("exception"), "contested", F.lit("")))
    )
    return found, findings


def recovered_checks(endpoints: DataFrame, checks: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """The checks of each endpoint, and before them the validation of its payload where every link of it is known: service, endpoint_id, id, expression, place."""
    valid = endpoints.join(payload_validation(endpoints, members, mappings).where("no_validation is null").select(SERVICE, "handler"), [SERVICE, "handler"], "left_semi")
    first = valid.select(SERVICE, F.concat_ws("::", "handler", "verb").alias("endpoint_id"), F.lit(VALIDATION_ID).alias("id"), F.lit(PAYLOAD_VALID).alias("expression"), F.lit(VALIDATION_PLACE).alias("place"))
    return checks.select(*CHAIN, "id", "expression", "place").unionByName(first.distinct())


# transitions
def synthesise(endpoints: DataFrame, outcomes: DataFrame, checks: DataFrame, members: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model of each service: states(service, state, is_initial, condition), transitions and findings.

    Each constructed outcome is a transition, guarded by its checks in order, negated where its sense is
    ``!``, after the condition under which the endpoint does not reject. Each rejection is one more. Of
    outcomes with one id the last (largest seq) stays. Endpoints without a transition are findings.

    Facts are dealt by service once, and joins and groups within a service shuffle nothing more: a code
    base bounds what a task streams. Names are made for routes, not for outcomes. What is read more than
    once (outcomes, handlers, endpoints with their rejection) is written to the shared folder first;
    transitions come as a plan, dealt by service.
    """
    outcomes.sparkSession.conf.set(DEALT, "false")
    root = graph.scratch(outcomes)
    outcomes = graph._written(outcomes, root, "outcomes")
    handlers = graph._written(_handlers(endpoints, members, mappings), root, "handlers")
    declined = graph._written(_declined(handlers, outcomes), root, "rejections")
    rejected, findings = _rejections(declined, endpoints, mappings)
    built = _keyed(outcomes).where("discriminator is null or discriminator <> 'declared'")
    one = [*CHAIN, "handler", "seq", "status", "discriminator", "sense"]
    words = checks.select(SERVICE, "id", "expression").repartition(SERVICE).groupBy(SERVICE, "id").agg(F.sort_array(F.collect_set("expression")).alias("_e"))
    rows = built.select(*one, F.posexplode_outer("checks").alias("_k", "id")).repartition(SERVICE).join(words, [SERVICE, "id"], "left")
    rows = rows.groupBy(*one).agg(F.flatten(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_e", F.array().cast("array<string>")).alias("_e"))))["_e"]).alias("_w"))
    ends = [SERVICE, "handler", "endpoint_id"]
    rows = rows.join(rejected.select(*ends, "success_guard").repartition(SERVICE), ends, "left")
    rows = rows.join(handlers.select(SERVICE, "handler", "_routes").repartition(SERVICE), [SERVICE, "handler"], "left").select("*", F.explode_outer("_routes").alias("_route"))
    # array_join leaves nulls out
    said = F.when(F.size("_w") > 0, F.when(F.col("sense") == "!", F.concat(F.lit("NOT ("), F.array_join("_w", ") AND NOT ("), F.lit(")"))).otherwise(F.array_join("_w", " AND ")))
    name = F.coalesce("_route.words", _label(F.coalesce("discriminator", F.lit("")), _NO_NAME))
    parts = ["trigger", "source", "guard", "status", "claim", "body", "constraints"]
    rows = rows.select(
        *ends, "seq", _named_state(name, F.col("status")).alias("target"), F.coalesce("_route.trigger", _tail()).alias("trigger"), F.when(F.col("_route.trigger").isNotNull(), F.col("_route.source")).otherwise(start_state(_tail())).alias("source"),
        F.concat_ws(" AND ", "success_guard", said).alias("guard"), "status", F.lit("constructed").alias("claim"), carried_body(F.col("status"), F.col("_route.body")).alias("body"), F.lit(None).cast("array<string>").alias("constraints"),
    )
    trigger = F.concat_ws(" ", "verb", "path")
    more = rejected.repartition(SERVICE).select(
        *ends, F.lit(1 << 62).alias("seq"), outcome_state(F.col("verb"), F.col("path"), F.col("status"), F.lit("rejected")).alias("target"), trigger.alias("trigger"), start_state(trigger).alias("source"),
        F.col("rejection_guard").alias("guard"), "status", "claim", F.col("response_body").alias("body"), "constraints",
    )
    last = Window.partitionBy(*ends, "target").orderBy(F.desc("seq"))
    t = rows.unionByName(more.select(*ends, "seq", "target", *parts)).withColumn("_r", F.row_number().over(last)).where("_r = 1")
    t = t.select(
        SERVICE, F.concat("endpoint_id", F.lit("->"), "target").alias("id"), "endpoint_id", "source", "trigger", "target", "guard",
        F.col("status").alias("outcome_status"), "claim", F.col("body").alias("response_body"), "constraints", F.lit(IMPLEMENTED).alias("status"), F.lit(QUARANTINE).alias("lifecycle"), F.lit(False).alias("source_unresolved"),
    )
    names = t.select(SERVICE, F.explode(F.array(F.struct(F.col("source").alias("state"), F.lit(True).alias("_i")), F.struct(F.col("target").alias("state"), F.lit(False).alias("_i")))).alias("_s")).select(SERVICE, "_s.*")
    states = names.groupBy(SERVICE, "state").agg(F.bool_or("_i").alias("is_initial")).withColumn("condition", F.lit(""))
    # a handler has a transition where its code constructs an outcome or its rejection is known
    silent = endpoints.select(SERVICE, "handler").repartition(SERVICE).distinct().join(declined.where("_builds or _known and _n > 0").select(SERVICE, "handler").repartition(SERVICE), [SERVICE, "handler"], "left_anti")
    unguarded = t.where("guard = ''")
    findings = findings.unionAll(silent.select(SERVICE, F.col("handler"), F.lit("nothing-derived"), F.lit("no outcome was recovered"))).unionAll(unguarded.select(SERVICE, F.col("id"), F.lit("unguarded"), F.lit("")))
    return states, t, findings


# unfolding
def _atoms(guard: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(guard, F.lit("")), r"(?i)\s+AND\s+"), F.trim), lambda a: a != "")


_PRESENCE = r"^(?:NOT\s*\()?\s*[A-Za-z_][\w.]*\.(isEmpty|isPresent)\(\)\s*\)?$"


def presence(guard: Column) -> Column:
    """struct(atom, present) of the first part of a guard that says whether a resource exists; null for none."""
    says = lambda a: F.struct(a.alias("atom"), (a.rlike(r"^NOT\s*\(") == (F.regexp_extract(a, _PRESENCE, 1) == "isEmpty")).alias("present"))
    return F.get(F.transform(F.filter(_atoms(guard), lambda a: a.rlike(_PRESENCE)), says), F.lit(0))


def without_atom(guard: Column, atom: Column) -> Column:
    """A guard without one of its parts; the others as they are."""
    return F.array_join(F.filter(_atoms(guard), lambda a: a != atom), " AND ")


def unfold(states: DataFrame | None, t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model in which the existence of a resource is a state and no guard: states, transitions, findings.

    A transition whose guard wants a resource starts from the resource's own ``...Present`` state, where
    the successful POST and PUT calls on its route lead to, and loses that part of its guard. Where none
    creates it, the transition stays and is marked. A transition from the resource's start state loses
    the part that says it is absent, and the state says it in its condition. States that nothing uses
    any more go, but for initial ones. Resources are known by route, never by a variable in a guard.
    Without states, they are those that t names, its sources being initial, and t is read once.
    """
    status = F.coalesce("outcome_status", F.lit(0))
    path = _route(F.col("trigger"))
    verb = F.upper(F.split_part(F.coalesce("trigger", F.lit("")), F.lit(" "), F.lit(1)))
    rows = t.repartition(SERVICE).withColumns({"_r": F.when(path != "", resource_of(path)), "_p": presence(F.col("guard"))}).withColumn("_creates", verb.isin(*CREATING) & status.between(200, 299) & F.col("_r").isNotNull())
    route = Window.partitionBy(SERVICE, "_r")
    there_is = F.bool_or("_creates").over(route) & F.bool_or(F.coalesce("_p.present", F.lit(False))).over(route)
    wants, denies = F.coalesce(F.col("_p.present"), F.lit(False)), F.coalesce(~F.col("_p.present"), F.lit(False))
    rows = rows.withColumn("_open", F.col("_r").isNotNull() & F.coalesce(there_is, F.lit(False)))
    # only where something changes is there a name to make
    label = F.when(F.col("_open"), resource_label(F.col("_r")))
    rows = rows.withColumn("_label", label).withColumns({"_moved": wants & F.col("_open"), "_stuck": wants & ~F.col("_open"), "_own": denies & F.col("_open") & (F.col("source") == F.col("_label")), "_lands": F.col("_creates") & F.col("_open"), "_there": F.concat("_label", F.lit("Present"))})
    atom = F.col("_p.atom")
    was = F.struct(F.col("source").alias("source"), F.col("target").alias("target"))
    changed = rows.withColumn("_was", was).withColumns({
        "guard": F.when(F.col("_moved") | F.col("_own"), without_atom(F.col("guard"), atom)).otherwise(F.col("guard")),
        "source": F.when(F.col("_moved"), F.col("_there")).otherwise(F.col("source")), "target": F.when(F.col("_lands"), F.col("_there")).otherwise(F.col("target")),
        "source_unresolved": F.coalesce("source_unresolved", F.lit(False)) | F.col("_stuck"),
    })
    out = changed.select(*t.columns)
    # each row says of a state whether it is there and initial, its condition, whether it is used, and what a transition adds to its condition
    no, yes = F.lit(False), F.lit(True)
    row = lambda state, there=no, first=None, used=no, says=None: F.struct(state.alias("state"), there.alias("_is"), (F.lit(None).cast("boolean") if first is None else first).alias("is_initial"), F.lit("").alias("condition"), used.alias("_used"), (F.lit(None).cast("string") if says is None else says).alias("_says"))
    own = F.when(F.col("_own"), F.concat(F.lit("no "), resource_noun(F.col("_r")), F.lit(" exists")))
    ends = [row(F.col("source"), there=F.col("_moved"), first=F.when(F.col("_moved"), no), used=yes, says=own), row(F.col("target"), used=yes)]
    if states is None:
        ends += [row(F.col("_was.source"), there=yes, first=yes), row(F.col("_was.target"), there=yes, first=no)]
    named = changed.select(SERVICE, F.explode(F.array(*ends)).alias("_s")).select(SERVICE, "_s.*")
    if states is not None:
        named = named.unionByName(states.select(SERVICE, "state", yes.alias("_is"), "is_initial", F.coalesce("condition", F.lit("")).alias("condition"), no.alias("_used"), F.lit(None).cast("string").alias("_says")))
    kept = named.groupBy(SERVICE, "state").agg(F.bool_or("_is").alias("_is"), F.bool_or("is_initial").alias("is_initial"), F.max("condition").alias("condition"), F.bool_or("_used").alias("_used"), F.min("_says").alias("_says")).where("_is and (_used or is_initial)")
    condition = F.when(F.col("condition") == "", F.coalesce("_says", F.lit(""))).otherwise(F.col("condition"))
    findings = changed.where("_stuck").select(SERVICE, F.col("id").alias("subject"), F.lit("source-unresolved").alias("kind"), F.coalesce("_r", F.lit("")).alias("detail")).unionAll(changed.where("_lands").select(SERVICE, "id", F.lit("creates"), "_there"))
    return kept.select(SERVICE, "state", "is_initial", condition.alias("condition")), out, findings
