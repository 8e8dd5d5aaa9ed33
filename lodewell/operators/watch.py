"""Watch targets against transactions: direct matches, descendants, replacements, severities.

Targets are joined, with no hint: whichever side is small is chosen from its size at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.lineage import cut

BTC = 100_000_000
#: Where in a transaction an activity is found: activities come in the order of stage // 10, position, stage.
STAGES = {
    "WATCHED_TRANSACTION_OBSERVED": 10, "WATCHED_TRANSACTION_CONFIRMED": 10, "WATCHED_OUTPOINT_SPENT": 20, "NEW_DESCENDANT_OBSERVED": 21, "WATCHED_ADDRESS_SPENT": 22,
    "WATCHED_SCRIPT_RECEIVED": 30, "WATCHED_ADDRESS_RECEIVED": 31, "TRANSACTION_REPLACEMENT": 40,
}


def active(targets: DataFrame, kind: str) -> DataFrame:
    return targets.filter(F.col("active") & (F.col("target_type") == kind))


def match(items: DataFrame, targets: DataFrame, on: Column, activity: str | Column, value: Column, strength: str | Column) -> DataFrame:
    """The activity of each item that a target matches; an item's arrival and position, where it has them, go along."""
    found = items.alias("i").join(targets.alias("t"), on)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    along = [F.col(f"i.{c}").alias(c) for c in ("arrival", "position") if c in items.columns]
    return found.select(F.col("i.txid").alias("txid"), F.col("t.id").alias("target_id"), lit(activity).alias("activity_type"), lit(strength).alias("correlation"), value.alias("value_sats"), *along)


def by_txid(tx: DataFrame, targets: DataFrame, confirmed: Column) -> DataFrame:
    kind = F.when(confirmed, "WATCHED_TRANSACTION_CONFIRMED").otherwise("WATCHED_TRANSACTION_OBSERVED")
    return match(tx, active(targets, "TRANSACTION"), F.lower("i.txid") == F.lower("t.txid"), kind, F.col("i.total_output_sats"), "DIRECT")


def by_outpoint(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    on = (F.lower("i.prev_txid") == F.lower("t.txid")) & (F.col("i.prev_vout") == F.col("t.vout"))
    return match(inputs, active(targets, "OUTPOINT"), on, "WATCHED_OUTPOINT_SPENT", F.col("i.value_sats"), "DIRECT")


def address_strength(classification: Column) -> Column:
    return F.when(classification == "ON_CHAIN_VERIFIED", "DIRECT").when(classification == "OFFICIALLY_ATTRIBUTED", "STRUCTURAL").otherwise("HEURISTIC")


def by_address(items: DataFrame, targets: DataFrame, spent: bool) -> DataFrame:
    """Addresses are compared as they are written."""
    kind = "WATCHED_ADDRESS_SPENT" if spent else "WATCHED_ADDRESS_RECEIVED"
    return match(items, active(targets, "ADDRESS"), F.col("i.address") == F.col("t.address"), kind, F.col("i.value_sats"), address_strength(F.col("t.classification")))


def by_script(outputs: DataFrame, targets: DataFrame) -> DataFrame:
    return match(outputs, active(targets, "SCRIPT"), F.lower("i.script_hex") == F.lower("t.script_hex"), "WATCHED_SCRIPT_RECEIVED", F.col("i.value_sats"), "DIRECT")


def by_replacement(replacements: DataFrame, targets: DataFrame) -> DataFrame:
    """One match a replacement: on its own id first, else the first watched replaced id in order."""
    tried = replacements.select(F.col("replacement_txid").alias("txid"), F.posexplode(F.concat(F.array("replacement_txid"), "replaced_txids")).alias("pos", "watched"))
    found = tried.join(active(targets, "TRANSACTION").select(F.col("txid").alias("t_txid"), F.col("id").alias("target_id")), F.lower("watched") == F.lower("t_txid"))
    first = found.groupBy("txid").agg(F.min(F.struct("pos", "target_id")).alias("m"))
    return first.select("txid", F.col("m.target_id").alias("target_id"), F.lit("TRANSACTION_REPLACEMENT").alias("activity_type"), F.lit("STRUCTURAL").alias("correlation"), F.lit(None).cast("bigint").alias("value_sats"))


def alert_severity(activity: Column, strength: Column, value: Column, btc: int = BTC) -> Column:
    """The first rule that holds decides; btc is a coin in the units of value."""
    v = F.coalesce(value, F.lit(0))
    return (
        F.when((activity == "WATCHED_OUTPOINT_SPENT") & (v >= 100 * btc), "CRITICAL")
        .when(activity == "WATCHED_OUTPOINT_SPENT", "HIGH")
        .when(strength == "HEURISTIC", "MEDIUM")
        .when((v >= 100 * btc) & (strength == "DIRECT"), "CRITICAL")
        .when(v >= 10 * btc, "HIGH")
        .when(activity == "WATCHED_TRANSACTION_OBSERVED", "LOW")
        .when((activity == "NEW_DESCENDANT_OBSERVED") & (v >= 5 * btc), "HIGH")
        .when(activity == "NEW_DESCENDANT_OBSERVED", "LOW")
        .otherwise("MEDIUM")
    )


def dedup_key(incident: Column, activity: Column, txid: Column, target: Column) -> Column:
    return F.concat_ws(":", incident, activity, F.coalesce(txid, F.lit("none")), target)


def lineage(seeds: DataFrame, spends: DataFrame, max_depth: int = 3) -> DataFrame:
    """Descendants of watched outputs: (txid, root, depth), level by level, max_depth held to 1..5.

    seeds: txid, root of transactions whose outputs are followed. spends: prev_txid, txid. A level is one equi-join;
    an output is spent once, so a level never grows beyond the outputs of the one before.
    """
    level = seeds.select("txid", "root", F.lit(0).alias("depth"))
    out = None
    for depth in range(1, min(max(max_depth, 1), 5) + 1):
        level = level.withColumnRenamed("txid", "prev_txid").join(spends, "prev_txid").select("txid", "root", F.lit(depth).alias("depth"))
        out = level if out is None else out.unionByName(level)
    return out


def _short(text: Column, most: int, ends: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, ends), F.lit("..."), F.right(text, F.lit(ends)))).otherwise(text)


def public_targets(targets: DataFrame) -> DataFrame:
    """Targets as outsiders may see them: identifiers shortened, sources and evidence left out."""
    kind = F.col("target_type")
    tx = _short(F.col("txid"), 12, 6)
    summary = (
        F.when(kind == "OUTPOINT", F.concat(F.lit("OutPoint: "), tx, F.lit(":"), F.col("vout").cast("string")))
        .when(kind == "ADDRESS", F.concat(F.lit("Address: "), _short(F.col("address"), 14, 6)))
        .when(kind == "TRANSACTION", F.concat(F.lit("Tx: "), tx))
        .otherwise(F.concat(F.lit("Script: "), _short(F.col("script_hex"), 16, 8)) if "script_hex" in targets.columns else F.lit(None))
    )
    return targets.select("id", "target_type", summary.alias("target_summary"), "classification", "active")


#: Columns of followed outputs.
POINT = "prev_txid string, prev_vout bigint, target_id string, depth int, point_sats bigint"


def advance(points: DataFrame | None, seeds: DataFrame, outputs: DataFrame, inputs: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(spends of followed outputs, outputs to follow from now on) of a step of transactions.

    points: what is followed from the steps before (POINT). seeds: txid, target_id of the step's transactions that spend a
    watched output. outputs: txid, vout (the place in the transaction), op_return, maybe value_sats. inputs: txid,
    prev_txid, prev_vout, value_sats, maybe arrival and position.

    Every output of a seed but data carriers is followed at depth 1, those of a spending transaction one deeper, up to
    max_depth, held to 1..5. A transaction that is reached at more than one depth is followed from the smallest. Each depth
    is one equi-join on the output; steps must come in the order of the chain and give the same as one step of all.
    """
    along = [c for c in ("arrival", "position") if c in inputs.columns]
    sats = F.col("value_sats") if "value_sats" in outputs.columns else F.lit(None).cast("bigint")
    carried = outputs.filter(~F.col("op_return")).select(F.col("txid").alias("prev_txid"), F.col("vout").cast("bigint").alias("prev_vout"), sats.alias("point_sats"))
    spent = inputs.select("txid", "prev_txid", F.col("prev_vout").cast("bigint").alias("prev_vout"), "value_sats", *along)
    order = ["prev_txid", "prev_vout", "target_id", "depth", "point_sats"]
    level, reached, out, entered = cut(seeds.select("txid", "target_id").distinct()), None, None, None
    for depth in range(1, min(max(max_depth, 1), 5) + 1):
        reached = level if reached is None else reached.unionByName(level)
        followed = level.withColumnRenamed("txid", "prev_txid").join(carried, "prev_txid").withColumn("depth", F.lit(depth)).select(order)
        entered = followed if entered is None else entered.unionByName(followed)
        if points is not None:
            followed = followed.unionByName(points.filter(F.col("depth") == depth).select(order))
        hits = followed.join(spent, ["prev_txid", "prev_vout"]).select("txid", "prev_txid", "prev_vout", "target_id", "depth", F.coalesce("value_sats", "point_sats").alias("value_sats"), *along)
        hits = cut(hits)  # a depth is joined once, however often the deeper ones ask for it
        out = hits if out is None else out.unionByName(hits)
        level = hits.select("txid", "target_id").distinct().join(reached, ["txid", "target_id"], "left_anti")
    return out, entered


def descendants(seeds: DataFrame, outputs: DataFrame, inputs: DataFrame, max_depth: int = 3) -> DataFrame:
    """Spends of outputs that descend from a watched one: txid, prev_txid, prev_vout, target_id, depth, value_sats (see ``advance``)."""
    return advance(None, seeds, outputs, inputs, max_depth)[0].select("txid", "prev_txid", "prev_vout", "target_id", "depth", "value_sats")


def _staged(found: DataFrame, depth: Column | None = None) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col("activity_type")]
    fill = {c: F.lit(0).cast(kind) for c, kind in (("arrival", "bigint"), ("position", "int")) if c not in found.columns}
    found = found.withColumns({**fill, "stage": stage, "depth": F.lit(None).cast("int") if depth is None else depth})
    return found.select(F.col("arrival").cast("bigint").alias("arrival"), "txid", "target_id", "activity_type", "correlation", F.col("value_sats").cast("bigint").alias("value_sats"), "depth", "stage", F.col("position").cast("int").alias("position"))


def direct(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, targets: DataFrame, outpoints: bool = True) -> DataFrame:
    """Activities that a transaction shows by itself, of a table or a stream; without ``outpoints`` the spends of watched outputs are left to who follows them."""
    found = [by_txid(tx, targets, F.col("i.height").isNotNull()), by_address(inputs, targets, True), by_address(outputs, targets, False)]
    found += [by_script(outputs, targets)] if "script_hex" in targets.columns else []
    out = None
    for one in found + ([by_outpoint(inputs, targets)] if outpoints else []):
        rows = _staged(one, F.when(F.col("activity_type") == "WATCHED_OUTPOINT_SPENT", 0))
        out = rows if out is None else out.unionByName(rows)
    return out


def engine(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, targets: DataFrame, max_depth: int = 3, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(activities, outputs to follow from now on) of a table of transactions, or of one step of many.

    Activities have arrival, stage and position, the order in which a follower of single transactions would tell them.
    """
    seeds = by_outpoint(inputs, targets).select("txid", "target_id")
    hits, entered = advance(points, seeds, outputs, inputs, max_depth)
    below = hits.withColumns({"activity_type": F.lit("NEW_DESCENDANT_OBSERVED"), "correlation": F.lit("STRUCTURAL")})
    return direct(tx, inputs, outputs, targets).unionByName(_staged(below, F.col("depth"))), entered


def emission(activities: DataFrame) -> list[Column]:
    """What activities are sorted by to come in the order of emission."""
    return [F.col("arrival"), F.floor(F.col("stage") / 10), F.col("position"), F.col("stage"), F.col("target_id")]


def described(activities: DataFrame, targets: DataFrame, incident: str | None = None, confirmed: Column | None = None, btc: int = BTC) -> DataFrame:
    """Activities as they are stored: incident, case and classification of their target, status, words, dedup key and severity."""
    own = {"incident_id": F.lit(incident).cast("string"), "case_id": F.lit(incident).cast("string"), "classification": F.lit(None).cast("string"), "label": F.lit(None).cast("string")}
    about = public_targets(targets.withColumns({c: F.lit(None).cast("string") for c in ("script_hex", "label") if c not in targets.columns})).select("id", "target_summary")
    known = targets.select(F.col("id"), *[(F.coalesce(F.col(c), v) if c in targets.columns else v).alias(c) for c, v in own.items()]).join(about, "id").withColumnRenamed("id", "target_id")
    rows = activities.join(known, "target_id").withColumnRenamed("classification", "confidence")
    words = F.initcap(F.replace(F.lower("activity_type"), F.lit("_"), F.lit(" ")))
    amount = F.when(F.col("value_sats").isNotNull(), F.concat(F.lit(", "), F.col("value_sats").cast("string"), F.lit(" sats"))).otherwise("")
    deep = F.when(F.col("depth") > 0, F.concat(F.lit(", depth "), F.col("depth").cast("string"))).otherwise("")
    return rows.withColumns({
        "status": F.when(F.lit(False) if confirmed is None else confirmed, "CONFIRMED").otherwise("MEMPOOL"),
        "description": F.concat(words, F.lit(" in "), F.col("txid"), amount, deep),
        "target_label": F.coalesce("label", "target_summary"),
        "dedup_key": dedup_key(F.coalesce("incident_id", F.lit("none")), F.col("activity_type"), F.col("txid"), F.col("target_id")),
        "severity": alert_severity(F.col("activity_type"), F.col("correlation"), F.col("value_sats"), btc),
    }).drop("label", "target_summary")


def firsts(rows: DataFrame) -> DataFrame:
    """Of described activities with one dedup key, the one that is emitted first."""
    order = ["arrival", "_group", "position", "stage"]
    rest = [c for c in rows.columns if c not in ("dedup_key", *order)]
    grouped = rows.withColumn("_group", F.floor(F.col("stage") / 10)).groupBy("dedup_key").agg(F.min_by(F.struct(*rest, *[c for c in order if c != "_group"]), F.struct(*order)).alias("r"))
    return grouped.select("dedup_key", "r.*")


#: Columns of a stored alert beside its id and the activity's.
ALERT = ("incident_id", "case_id", "incident_title", "severity", "title", "summary", "confidence", "correlation", "observed_at", "value_sats", "txid")


def alerted(activities: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Described activities with incident_title, title and summary of their alerts.

    titles: case_id, title of incidents, which else are named by their case.
    """
    rows = activities if titles is None else activities.join(titles.select("case_id", F.col("title").alias("case_title")), "case_id", "left")
    words = F.initcap(F.replace(F.lower("activity_type"), F.lit("_"), F.lit(" ")))
    case = F.coalesce("case_id", "incident_id", F.lit("none"))
    named = F.concat(F.lit("Incident "), case)
    told = F.concat(F.col("description"), F.lit(". Target: "), F.coalesce("target_label", F.lit("unknown")), F.lit(" ("), F.coalesce("confidence", F.lit("UNVERIFIED")), F.lit(", "), F.col("correlation"), F.lit(")"))
    made = {"incident_title": named if titles is None else F.coalesce("case_title", named), "title": F.concat(F.lit("["), case, F.lit("] "), words), "summary": told}
    return rows.withColumns(made).drop("case_title")


def alerts(activities: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """An alert for each described activity: ALERT and dedup_key."""
    rows = alerted(activities, titles)
    return rows.select("dedup_key", *[c for c in ALERT if c in rows.columns])


def timeline(activities: DataFrame) -> DataFrame:
    """Timeline entries of activities. Movement is not recovery: figures of the incident are left as they are."""
    words = F.initcap(F.replace(F.lower("activity_type"), F.lit("_"), F.lit(" ")))
    return activities.select("incident_id", F.col("observed_at").alias("at"), words.alias("title"), "txid", F.col("correlation").alias("evidence_strength"), F.coalesce("value_sats", F.lit(0)).alias("value_sats"), "dedup_key")


def simulate(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, replacements: DataFrame, targets: DataFrame, incident: str, max_depth: int = 3) -> DataFrame:
    """All activities of a scenario with their words, alert severities and dedup keys: those of the engine, then replacements."""
    if not {"vout", "op_return"} <= set(outputs.columns):
        outputs = outputs.withColumns({"vout": F.lit(0).cast("bigint"), "op_return": F.lit(False)})
    found = engine(tx, inputs, outputs, targets, max_depth)[0].unionByName(_staged(by_replacement(replacements, targets)))
    return described(found, targets, incident)
