"""Names: alias dictionaries, resolution, learned aliases, type votes, first appearances, display labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.tables import saved
from loregraph.functions.text import clean, has_upper, norm, strip, words
from loregraph.operators.graph import find_forms


@dataclass
class Dicts:
    """The rule tables. aliases(key, canon); stop(name); places(name, canon); surnames(token, canon, ord); shared(token)."""

    aliases: DataFrame
    stop: DataFrame
    places: DataFrame
    surnames: DataFrame
    shared: DataFrame


def alias_dict(groups: DataFrame) -> DataFrame:
    """(key, canon) from groups(canon, variant, ord): normalised names and variants; the last entry of a key counts."""
    own = groups.select(norm(F.col("canon")).alias("key"), "canon", F.struct(F.col("ord"), F.lit(0)).alias("at"))
    both = own.union(groups.where("variant is not null").select(norm(F.col("variant")), "canon", F.struct(F.col("ord"), F.lit(1))))
    return both.groupBy("key").agg(F.max_by("canon", "at").alias("canon"))


def resolve(df: DataFrame, column: str, dicts: Dicts, out: str = "resolved") -> DataFrame:
    """df with the canonical name of a column, null for what is no name. In order: empty; stop list, by the normalised or the
    stripped lower-case name; place; alias; distinctive surname, unless a shared one is there too; no capital; the name."""
    names = df.select(F.col(column).alias("_name")).distinct().withColumn("_norm", norm(F.col("_name"))).withColumn("_low", F.lower(strip(F.col("_name"))))
    stop = dicts.stop.select(F.col("name").alias("_stop")).distinct()
    places = dicts.places.select(F.col("name").alias("_norm"), F.col("canon").alias("_place"))
    aliases = dicts.aliases.select(F.col("key").alias("_norm"), F.col("canon").alias("_alias"))
    tokens = names.select("_name", F.explode(F.array_distinct(words(F.col("_norm")))).alias("token"))
    blocked = tokens.join(dicts.shared.select("token").distinct(), "token", "left_semi").select("_name").distinct().withColumn("_blocked", F.lit(True))
    by_surname = tokens.join(dicts.surnames, "token").groupBy("_name").agg(F.min_by("canon", "ord").alias("_surname"))
    met = (
        names.join(stop.select(F.col("_stop").alias("_norm"), F.lit(True).alias("_s1")), "_norm", "left")
        .join(stop.select(F.col("_stop").alias("_low"), F.lit(True).alias("_s2")), "_low", "left")
        .join(places, "_norm", "left").join(aliases, "_norm", "left").join(by_surname, "_name", "left").join(blocked, "_name", "left")
    )
    value = (
        F.when(F.col("_name").isNull() | (F.col("_low") == "") | (F.col("_norm") == "") | F.col("_s1") | F.col("_s2"), F.lit(None))
        .when(F.col("_place").isNotNull(), F.col("_place"))
        .when(F.col("_alias").isNotNull(), F.col("_alias"))
        .when(F.col("_surname").isNotNull() & F.col("_blocked").isNull(), F.col("_surname"))
        .when(has_upper(F.col("_name")), clean(F.col("_name")))
    )
    known = met.select(F.col("_name").alias(column), value.alias(out)).where(F.col(column).isNotNull())
    return df.join(known, column, "left").select(*df.columns, out)


def _candidates(entities: DataFrame, dicts: Dicts) -> DataFrame:
    """(corpus_id, ord, name, alias, key) for each alias of a mention that could be learned."""
    rows = entities.select("corpus_id", "pass", "doc_id", "ent_pos", "name", F.posexplode("aliases").alias("pos", "alias"))
    rows = rows.select("corpus_id", F.struct("pass", "doc_id", "ent_pos", "pos").alias("ord"), "name", "alias", norm(F.col("alias")).alias("key"))
    rows = rows.where((F.col("key") != "") & has_upper(F.col("alias")))
    return rows.join(dicts.stop.select(F.col("name").alias("key")), "key", "left_anti")


def _judged(rows: DataFrame, dicts: Dicts) -> DataFrame:
    """rows with resolved names and a reason of rejection, or none."""
    tokens = rows.select("key", F.explode(words(F.col("key"))).alias("token")).distinct()
    named = tokens.join(dicts.shared.select("token").distinct(), "token", "left_anti").select("key").distinct().withColumn("_named", F.lit(True))
    canon = F.filter(words(norm(F.col("canon"))), lambda w: F.length(w) > 2)
    reason = F.when(F.col("_named").isNull(), "surname only").when(~F.arrays_overlap(words(F.col("key")), canon), "no overlap")
    return rows.join(named, "key", "left").withColumn("reason", reason).drop("_named")


def learn_aliases(entities: DataFrame, dicts: Dicts) -> tuple[DataFrame, DataFrame]:
    """(accepted(corpus_id, key, canon, ord), rejected(corpus_id, alias, canon, reason, ord)) from mentions (corpus_id, pass,
    doc_id, ent_pos, name, aliases), each corpus by itself.

    In run order the first good mention of an alias counts, and a learned alias resolves the names after it. Each round
    resolves all mentions with what the round before has learned earlier in the order; the entries that are right grow from
    the front, by one at least, until nothing changes, which is the result of a scan in run order.
    """
    found = resolve(_candidates(entities, dicts).join(dicts.aliases.select("key"), "key", "left_anti"), "name", dicts, "canon0").withColumn("own", norm(F.col("name")))
    fixed = dicts.aliases.select(F.col("key").alias("own")).union(dicts.places.select("name")).union(dicts.stop.select("name")).distinct().withColumn("fixed", F.lit(True))
    found = saved(found.join(fixed, "own", "left"))

    def judged(known: DataFrame) -> DataFrame:
        earlier = known.select("corpus_id", F.col("key").alias("own"), F.col("canon").alias("learned"), F.col("ord").alias("since"))
        met = found.join(earlier, ["corpus_id", "own"], "left")
        canon = F.when(F.col("fixed") | F.col("since").isNull() | (F.col("since") >= F.col("ord")), F.col("canon0")).otherwise(F.col("learned"))
        return _judged(met.withColumn("canon", canon).where("canon is not null"), dicts)

    accepted, state = found.select("corpus_id", "key", F.col("canon0").alias("canon"), "ord").where("false"), None
    while True:
        accepted = saved(judged(accepted).where("reason is null").groupBy("corpus_id", "key").agg(F.min_by("canon", "ord").alias("canon"), F.min("ord").alias("ord")))
        seen = accepted.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("corpus_id", "key", "canon", "ord")).alias("x")).first()
        if (seen.n, seen.x) == state:
            break
        state = (seen.n, seen.x)
    late = judged(accepted).where("reason is not null").join(accepted.select("corpus_id", "key", F.col("ord").alias("since_")), ["corpus_id", "key"], "left").where("since_ is null or ord < since_")
    return accepted, late.select("corpus_id", "alias", "canon", "reason", "ord")


def vote_types(mentions: DataFrame) -> DataFrame:
    """(corpus_id, name, type): the most frequent type of each resolved name, of equal ones the first in run order.
    mentions: corpus_id, pass, doc_id, ent_pos, name (resolved), type."""
    votes = mentions.where("name is not null").groupBy("corpus_id", "name", "type").agg(F.count("*").alias("n"), F.min(F.struct("pass", "doc_id", "ent_pos")).alias("first"))
    return votes.groupBy("corpus_id", "name").agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("type"))


def alias_first_seen(aliases: DataFrame, nodes: DataFrame, sections: DataFrame, descriptive: list[str], kind: str = "Character") -> DataFrame:
    """(corpus_id, canon, alias, first_index, display): the first section whose raw text holds the alias of a node of the
    kind. display: no descriptive word and three words at most."""
    people = nodes.where(F.col("type") == kind).select("corpus_id", F.col("id").alias("canon"))
    forms = people.join(aliases.select("canon", "key"), "canon").select("corpus_id", F.col("canon").alias("key"), F.col("key").alias("form"))
    forms = forms.withColumn("form", F.lower("form")).distinct()  # each is looked for once, however many names have it
    first = find_forms(forms.select("corpus_id", F.col("form").alias("key"), "form").distinct(), sections, collapsed=False).groupBy("corpus_id", "form").agg(F.min("global_index").alias("first_index"))
    seen = forms.join(first, ["corpus_id", "form"]).select("corpus_id", F.col("key").alias("canon"), F.col("form").alias("alias"), "first_index")
    return seen.withColumn("display", is_display(F.col("alias"), descriptive))


def is_display(alias: Column, descriptive: list[str]) -> Column:
    """descriptive: words that make an alias a description rather than a name."""
    pattern = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(descriptive)})($|[^\p{{L}}\p{{N}}_])"
    return ~alias.rlike(pattern) & (F.size(words(alias)) <= 3)


def with_labels(df: DataFrame, node_labels: DataFrame, rel_labels: DataFrame) -> DataFrame:
    """df(subject, relation, object) with labels, by default the names themselves, and a display line. rel_labels has a row a
    relation and is sent to all tasks, as in `validate_triples`."""
    for column, labels in (("subject", node_labels), ("relation", rel_labels), ("object", node_labels)):
        own = labels.select(F.col("id").alias(column), F.col("label").alias(f"{column}_label"))
        df = df.join(F.broadcast(own) if column == "relation" else own, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))
    return df.withColumn("line", F.format_string("%s ─[%s]→ %s", "subject_label", "relation_label", "object_label"))


