"""Checks of new records: set-based flags over tables, and a fold in arrival order that sees what it has just accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import words
from ..functions.scoring import dot
from ..functions.text import SPACE, ascii_lower, category, guard_tokens, postings, side_tokens, spread, vague_snapshot, word_count
from ..steps import Steps
from . import similar

MAIN = {"decision": "what", "snapshot": "file_structure", "open_task": "description", "dead_end": "what_tried"}
REQUIRED = {"decision": ("what",), "snapshot": ("file_structure",), "open_task": ("description",), "dead_end": ("what_tried", "why_failed")}
NAMES = {"decision": "decision", "open_task": "task", "dead_end": "dead end"}


def required(kind: str) -> Column:
    """The first required field that is blank, or null."""
    blank = [F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in REQUIRED[kind]]
    return F.coalesce(*blank) if len(blank) > 1 else blank[0]


def vague(kind: str) -> Column:
    c = F.col(MAIN[kind])
    return vague_snapshot(c) if kind == "snapshot" else word_count(c) < words.LEAST_WORDS


def exact_pairs(df: DataFrame) -> DataFrame:
    """(project, id, other): the first earlier record with the same text but for ASCII case; df: project, id, seq, what.

    The first of each text is a pre-aggregated minimum, joined back, so a text that fills a table is sorted nowhere.
    """
    keyed = df.select("project", "id", "seq", ascii_lower(F.trim("what")).alias("key"))
    first = keyed.groupBy("project", "key").agg(F.min(F.struct("seq", "id")).alias("m"))
    return keyed.join(first, ["project", "key"]).where("m.seq < seq").select("project", "id", F.col("m.id").alias("other"))


def fuzzy_pairs(df: DataFrame, least: float = words.SIMILAR) -> DataFrame:
    """(project, id, other, sim): the first earlier record with a Jaccard similarity of at least `least`.

    Equal token sets join once, through a representative, by the filters of similar.within.
    """
    steps = Steps(df.sparkSession)
    sets = spread(df.select("project", "id", "seq", "what"), "id").select(F.col("project").alias("scope"), "id", "seq", F.array_sort(guard_tokens(F.col("what"))).alias("t")).where(F.size("t") > 0)
    # written once: what follows reads it from many sides, each with columns of its own, which no exchange could serve
    sets = steps.keep(sets)
    reps = sets.groupBy("scope", "t").agg(F.min(F.struct("seq", "id")).alias("m")).withColumn("nth", F.monotonically_increasing_id())
    reps = steps.keep(reps.select("scope", "t", F.struct("m.seq", "m.id", "nth").alias("rep")))
    near = similar.first(reps.select("scope", F.col("rep").alias("sid"), "t"), None, least).select("scope", F.col("x").alias("rep"), "y", "sim")
    # what a record is too similar to first: the earliest record of a set near its own before that, or else of its own
    first = reps.join(near, ["scope", "rep"], "left").select("scope", "t", F.coalesce("y", "rep").alias("m"), F.coalesce("sim", F.lit(1.0)).alias("sim"))
    return sets.join(first, ["scope", "t"]).where("m.seq < seq").select(F.col("scope").alias("project"), "id", F.col("m.id").alias("other"), "sim")


def choices(df: DataFrame) -> DataFrame:
    """(project, id, seq, rank, l, r): the words on both sides of each marker of a choice; df: project, id, seq, what."""
    m = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("mark")) for i, x in enumerate(words.MARKERS)])).alias("m")
    low = df.select("project", "id", "seq", F.lower("what").alias("low"), m).where("contains(low, m.mark)")
    left, right = F.expr("left(low, instr(low, m.mark) - 1)"), F.expr("substr(low, instr(low, m.mark) + length(m.mark))")
    return low.select("project", "id", "seq", "m.rank", side_tokens(left).alias("l"), side_tokens(right).alias("r"))


def contradictions(new: DataFrame, existing: DataFrame, order: bool = False) -> DataFrame:
    """(project, id, other): the first existing record that takes the opposite side of a choice; with `order`, its seq as `at` besides.

    The two meet on project, marker, and a word that stands left in one and right in the other, so no pairs are formed
    but those that swap a word; both: project, id, seq, what.
    """
    n = choices(new).select("project", "rank", "id", F.col("l").alias("nl"), F.col("r").alias("nr"), F.explode("l").alias("w"))
    e = choices(existing).select("project", "rank", F.col("id").alias("other"), F.col("seq").alias("at"), F.col("l").alias("el"), F.col("r").alias("er"), F.explode("r").alias("w"))
    swapped = F.arrays_overlap("nl", "er") & F.arrays_overlap("nr", "el") & ~(F.arrays_overlap("nl", "el") & F.arrays_overlap("nr", "er"))
    out = n.join(e, ["project", "rank", "w"]).where(swapped).groupBy("project", "id").agg(F.min(F.struct("at", "rank", "other")).alias("m"))
    return out.select("project", "id", F.col("m.other").alias("other"), *([F.col("m.at").alias("at")] if order else []))


def opposed_pairs(new: DataFrame, existing: DataFrame, least: float = words.OPPOSED) -> DataFrame:
    """(project, id, e_seq, other): existing records before a new one with a similar vector, a token in common and a phrase of replacement in either.

    Records meet on project and token, and only where one of the two has such a phrase, so no pairs are formed but of these; both need `embedding`.
    """
    def told(df: DataFrame, names: dict[str, str]) -> DataFrame:
        cue = F.lit(False)
        for x in words.REPLACED:
            cue = cue | F.contains(F.lower("what"), F.lit(x))
        return df.withColumn("cue", cue).select("project", "id", "seq", "cue", "embedding").withColumnsRenamed(names)

    n = told(new, {"seq": "n_seq", "cue": "n_cue", "embedding": "n_vector"})
    e = told(existing, {"id": "other", "seq": "e_seq", "cue": "e_cue", "embedding": "e_vector"})
    tokens = lambda df, name, cues: postings(df, ["project", "id"], ["what"]).select("project", F.col("id").alias(name), "token").join(cues.select("project", name).distinct(), ["project", name], "left_semi")
    whole, part = tokens(new, "id", n), tokens(existing, "other", e)
    cued = tokens(new, "id", n.where("n_cue")).join(part, ["project", "token"]), whole.join(tokens(existing, "other", e.where("e_cue")), ["project", "token"])
    pairs = cued[0].unionByName(cued[1].select(*cued[0].columns)).select("project", "id", "other").distinct()
    near = pairs.join(n, ["project", "id"]).join(e, ["project", "other"]).where((F.col("n_cue") | F.col("e_cue")) & (F.col("e_seq") < F.col("n_seq")))
    return near.where(dot(F.col("n_vector"), F.col("e_vector")) >= least).select("project", "id", "e_seq", "other")


def opposed(new: DataFrame, existing: DataFrame, least: float = words.OPPOSED) -> DataFrame:
    """(project, id, other): the first of these."""
    near = opposed_pairs(new, existing, least)
    return near.groupBy("project", "id").agg(F.min(F.struct("e_seq", "other")).alias("m")).select("project", "id", F.col("m.other").alias("other"))


def reasons(new: DataFrame) -> DataFrame:
    """(project, id, reason) of decisions against all earlier ones of the same table, whatever became of those: first rule that fails."""
    exact = exact_pairs(new).select("project", "id", F.lit(1).alias("exact"))
    opp = contradictions(new, new).join(new.select("id", F.col("seq").alias("s")), "id").join(new.select(F.col("id").alias("other"), F.col("seq").alias("o")), "other").where("o < s").select("project", "id", F.lit(1).alias("opp"))
    near = fuzzy_pairs(new).select("project", "id", F.lit(1).alias("near"))
    # what a record's own text says is told before anything is joined, so that no text travels
    own = F.when(required("decision").isNotNull(), "Missing required field").when(vague("decision"), "Too vague")
    told = new.select("project", "id", own.alias("own"), (F.trim(F.coalesce(F.col("why"), F.lit(""))) == "").alias("no_why"))
    out = told.join(exact, ["project", "id"], "left").join(opp, ["project", "id"], "left").join(near, ["project", "id"], "left")
    reason = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("exact") == 1, "Exact duplicate")
        .when(F.col("opp") == 1, "Contradicts existing decision")
        .when(F.col("near") == 1, "Too similar to existing decision")
        .when(F.col("no_why"), "Missing 'why' field")
        .otherwise("ok")
    )
    return out.select("project", "id", reason.alias("reason"))


# The fold: what one record at a time in order of arrival would come to, each judged by what was accepted before it.
#: Earlier records of a list of postings that a round of the fold looks at; doubled from round to round.
NEAREST = 1024


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}|{SPACE}$", "")


def main_text(kind: Column, data: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, data[f]) for k, f in MAIN.items()])


def scope(kind: Column, project: Column) -> Column:
    """What records are compared within: a project's records of a kind; a null project is one of its own."""
    return F.concat(kind, F.coalesce(F.concat(F.lit("+"), project), F.lit("-")))


def own_reason(kind: Column, data: Column) -> Column:
    """The first rule that a record fails on its own, or null; a lack of reasons comes last and is not among them."""
    missing = F.coalesce(*[F.when((kind == k) & (stripped(data[f]) == ""), F.lit(f)) for k, fields in REQUIRED.items() for f in fields])
    text, n = main_text(kind, data), word_count(main_text(kind, data))
    least = F.concat(F.lit("Too vague — '"), F.coalesce(*[F.when(kind == k, F.lit(f)) for k, f in MAIN.items()]), F.lit("' needs "))
    # The texts of reasons, from which categories are cut.
    return (
        F.when(~kind.isin(*MAIN) | kind.isNull(), F.concat(F.lit("Unknown type: "), F.coalesce(kind, F.lit("None"))))
        .when(missing.isNotNull(), F.concat(F.lit("Missing required field: '"), missing, F.lit("'")))
        .when((kind == "snapshot") & vague_snapshot(text), F.concat(least, F.lit("more detail")))
        .when((kind != "snapshot") & (n < words.LEAST_WORDS), F.concat(least, F.lit(f"at least {words.LEAST_WORDS} words (got "), n.cast("string"), F.lit(")")))
    )


NO_REASON = "Missing 'why' field — decisions without reasoning lose value over time"


def likes(scope_: Column, text: Column) -> Column:
    """The sorted tokens that likeness is measured by; a text without any is like none but those that are the same, if such count at all."""
    t = F.array_sort(guard_tokens(text))
    none = F.when(scope_.startswith("dead_end"), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("= "), ascii_lower(text))))
    return F.when(F.size(t) > 0, t).otherwise(none)


def _tokens(df: DataFrame) -> DataFrame:
    """df with likes() as t, where it doesn't have it already."""
    return (df if "t" in df.columns else df.withColumn("t", likes(F.col("scope"), F.col("text")))).where(F.size("t") > 0)


def hits(classes: DataFrame, held: DataFrame) -> DataFrame:
    """(scope, key, exact, opposed, near) of classes that something held stands against; each the first held record, by fresh and seq.

    classes: scope, key, text, one text of each; held: scope, fresh, seq, text; where both have `embedding`, decisions are
    compared by meaning besides, and where they have `t`, it is what likes() gives. Texts that agree but for ASCII case, and token sets that agree, are
    collapsed on both sides before anything is joined. Where classes have `first`, the seq of their first record, those with an equal held text before it
    are looked up no further.
    """
    first = F.min(F.struct("fresh", "seq", "text"))
    exact = held.where("scope not like 'dead_end%'").groupBy("scope", ascii_lower(F.col("text")).alias("same")).agg(first.alias("m"))
    exact = classes.select("scope", "key", ascii_lower(F.col("text")).alias("same")).join(exact, ["scope", "same"]).select("scope", "key", F.col("m").alias("exact"))
    steps = Steps(classes.sparkSession)
    if "first" in classes.columns:
        exact = steps.keep(exact)
        settled = classes.join(exact, ["scope", "key"]).where(F.struct("exact.fresh", "exact.seq") < F.struct(F.lit(1), F.col("first")))
        classes = steps.keep(classes.join(settled.select("scope", "key"), ["scope", "key"], "left_anti").drop("first"))
    mine, theirs = steps.keep(_tokens(classes).select("scope", "key", "t", F.md5(F.array_join("t", " ").cast("binary")).alias("same_set"))), _tokens(held)
    a = steps.keep(mine.groupBy("scope", "same_set").agg(F.first("t").alias("t")).withColumn("sid", F.monotonically_increasing_id()))
    b = steps.keep(theirs.groupBy("scope", "t").agg(first.alias("m")).withColumn("sid", F.struct("m.fresh", "m.seq", F.monotonically_increasing_id().alias("nth"))))
    links = similar.first(a.select("scope", "sid", "t"), b.select("scope", "sid", "t"), words.SIMILAR)
    near = links.join(b.select("scope", F.col("sid").alias("y"), "m"), ["scope", "y"]).join(a.select("scope", F.col("sid").alias("x"), "same_set"), ["scope", "x"])
    near = mine.select("scope", "key", "same_set").join(near, ["scope", "same_set"]).groupBy("scope", "key").agg(F.min(F.struct("m", "sim")).alias("near"))
    swaps = contradictions(_told(classes, True), _told(held, False), order=True)
    swaps = swaps.select(F.col("project").alias("scope"), F.col("id").alias("key"), F.struct(F.col("at.fresh").alias("fresh"), F.col("at.seq").alias("seq"), F.col("other").alias("text")).alias("swap"))
    out = exact.join(near, ["scope", "key"], "full").join(swaps, ["scope", "key"], "full")
    if "embedding" not in classes.columns:
        return out.withColumn("meant", F.lit(None).cast("struct<fresh:int,seq:bigint,text:string>"))
    return out.join(_meant(classes, held), ["scope", "key"], "full")


def _told(df: DataFrame, new: bool) -> DataFrame:
    """Decisions as contradictions() takes them, new ones behind all that is held."""
    seq = F.struct(F.lit(9).alias("fresh"), F.lit(0).cast("long").alias("seq")) if new else F.struct("fresh", "seq")
    more = ["embedding"] if "embedding" in df.columns else []
    return df.where("scope like 'decision%'").select(F.col("scope").alias("project"), F.col("key" if new else "text").alias("id"), seq.alias("seq"), F.col("text").alias("what"), *more)


def _meant(classes: DataFrame, held: DataFrame) -> DataFrame:
    """(scope, key, meant): the first held decision that a class is against by meaning."""
    theirs = _told(held, False).withColumn("id", F.struct("id", "seq"))
    first = opposed_pairs(_told(classes, True), theirs).groupBy("project", "id").agg(F.min(F.struct("e_seq", "other.id")).alias("m"))
    return first.select(F.col("project").alias("scope"), F.col("id").alias("key"), F.struct(F.col("m.e_seq.fresh").alias("fresh"), F.col("m.e_seq.seq").alias("seq"), F.col("m.id").alias("text")).alias("meant"))


def hits_of_one(classes: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """What hits() gives, for classes that are one row, of this text: a scan of what is held in its scope, beside which the row is sent, and one aggregate."""
    mine = classes.select("scope", "key", F.col("text").alias("own"), likes(F.col("scope"), F.col("text")).alias("own_t"))
    both = held.withColumn("t", likes(F.col("scope"), F.col("text"))).join(F.broadcast(mine), "scope")
    swap, low, own = F.lit(False), F.lower("text"), F.lower("own")
    for m in [m for m in words.MARKERS if m in text.lower()]:
        cut = lambda c, m=m: (side_tokens(F.substring_index(c, m, 1)), side_tokens(F.substr(c, F.instr(c, m) + len(m))))
        (a, b), (c, d) = cut(own), cut(low)
        over = F.arrays_overlap
        swap = swap | (F.contains(own, F.lit(m)) & F.contains(low, F.lit(m)) & over(a, d) & over(b, c) & ~(over(a, c) & over(b, d)))
    common = F.size(F.array_intersect("t", "own_t"))
    sim = common / F.greatest(F.size("t") + F.size("own_t") - common, F.lit(1))
    it = F.struct("fresh", "seq", "text")
    same = ~F.col("scope").startswith("dead_end") & (ascii_lower(F.col("text")) == ascii_lower(F.col("own")))
    out = both.groupBy("scope", "key").agg(
        F.min(F.when(same, it)).alias("exact"), F.min(F.when(F.col("scope").startswith("decision") & swap, it)).alias("swap"),
        F.min(F.when(sim >= words.SIMILAR, F.struct(it.alias("m"), sim.alias("sim")))).alias("near"))
    if "embedding" not in classes.columns:
        return out.withColumn("meant", F.lit(None).cast("struct<fresh:int,seq:bigint,text:string>"))
    return out.join(_meant(classes, held), ["scope", "key"], "left")


AGAINST = "exact is not null or swap is not null or meant is not null or near is not null"


def _edges(steps: Steps, reps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(active, edges): the records all of whose lists of postings show at most `most` earlier ones, and (scope, later, earlier) among those shown.

    Lists are those of rare tokens (for similar texts) and of swapped words (for choices); of a list only its first `most` records
    are looked at, so a list that a hot group fills costs most * most at the most, and nothing that could stand against an active record is left out.
    """
    sets = _tokens(reps).select("scope", F.col("seq").alias("sid"), "t")
    sets = sets if "t" in reps.columns else steps.keep(sets)
    listed = similar.listed(similar.coded(steps, sets, similar.codes(steps, sets)), words.SIMILAR)
    seen, hidden = similar.heads(steps, listed, ["scope", "token"], most, most)
    sides = choices(reps.where("scope like 'decision%'").select(F.col("scope").alias("project"), F.col("seq").alias("id"), "seq", F.col("text").alias("what")))
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("ws")), F.struct(F.lit(1).alias("side"), F.col("r").alias("ws")))).alias("x")
    sides = sides.select(F.col("project").alias("scope"), F.col("id").alias("sid"), "rank", "l", "r", both).select("scope", "sid", "rank", "l", "r", "x.side", F.explode("x.ws").alias("w"))
    # both sides of a word make one list, so that whoever sees its own place in it sees all before it
    sides_seen, sides_hidden = similar.heads(steps, steps.keep(sides), ["scope", "rank", "w"], most, most)
    active = reps.select("scope", "seq")
    for x in (hidden, sides_hidden):
        active = active if x is None else active.join(x.select("scope", F.col("sid").alias("seq")).distinct(), ["scope", "seq"], "left_anti")
    near = similar.met(seen, seen, words.SIMILAR, F.col("a.sid") > F.col("b.sid")).select("scope", F.col("x").alias("later"), F.col("y").alias("earlier"))
    x, y = sides_seen.where("side = 0").alias("x"), sides_seen.where("side = 1").alias("y")
    swap = lambda a, b: F.arrays_overlap(f"x.{a}", f"y.{b}")
    meet = (F.col("x.scope") == F.col("y.scope")) & (F.col("x.rank") == F.col("y.rank")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.sid") != F.col("y.sid")) & swap("l", "r") & swap("r", "l") & ~(swap("l", "l") & swap("r", "r"))
    swaps = x.join(y, meet).select(F.col("x.scope").alias("scope"), F.greatest("x.sid", "y.sid").alias("later"), F.least("x.sid", "y.sid").alias("earlier"))
    return active, near.unionByName(swaps).distinct()


def _greedy(steps: Steps, reps: DataFrame, needs: DataFrame, meant: DataFrame | None) -> DataFrame:
    """(scope, seq, text) of the records that are accepted when each is turned down that an earlier accepted one stands against.

    A round takes the records that see all earlier ones that matter to them, draws the edges among these, and settles those all of whose
    earlier neighbours are settled, until nothing moves; then whatever is left and stands against an accepted one goes. The first
    record of a list always sees all of it, so every round gets on, and lists shown double in length. needs: (scope, seq, of, nth)
    of records that name a decision of the batch, which must be accepted first. meant: edges between decisions by meaning.
    """
    done, most, linked = None, NEAREST, not needs.isEmpty()
    while not reps.isEmpty():
        active, edges = _edges(steps, reps, most)
        active = steps.keep(active)
        edges = edges.unionByName(meant) if meant is not None else edges
        edges = steps.keep(edges.join(active.withColumnRenamed("seq", "later"), ["scope", "later"], "left_semi"))
        state = steps.keep(reps.select("scope", "seq").join(active.withColumn("live", F.lit(True)), ["scope", "seq"], "left").select("scope", "seq", F.when(F.col("live"), "open").otherwise("wait").alias("is")))
        moved = 1
        while moved:
            beside = edges.join(state.withColumnRenamed("seq", "earlier"), ["scope", "earlier"]).groupBy("scope", F.col("later").alias("seq"))
            beside = beside.agg(F.max(F.col("is") == "in").alias("hit"), F.max(F.col("is").isin("open", "wait")).alias("held"))
            after = state.join(beside, ["scope", "seq"], "left")
            if linked:
                settled = state if done is None else state.unionByName(done.select("scope", "seq", F.lit("in").alias("is")))
                named = needs.join(settled.select(F.col("scope").alias("of"), F.col("seq").alias("nth"), F.col("is").alias("need")), ["of", "nth"], "left")
                after = after.join(named.select("scope", "seq", F.coalesce("need", F.lit("out")).alias("need")), ["scope", "seq"], "left")
            else:
                after = after.withColumn("need", F.lit(None).cast("string"))
            verdict = F.when(F.col("is") != "open", F.col("is")).when(F.col("hit") | (F.col("need") == "out"), "out").when(F.col("held") | F.col("need").isin("open", "wait"), "open").otherwise("in")
            after = steps.keep(after.select("scope", "seq", verdict.alias("is"), (F.col("is") == "open").alias("was")))
            moved = after.where("was and is <> 'open'").count()
            state = after.drop("was")
        fresh = steps.keep(reps.join(state.where("is = 'in'"), ["scope", "seq"], "left_semi"))
        done = fresh if done is None else done.unionByName(fresh)
        rest = reps.join(state.where("is in ('open', 'wait')"), ["scope", "seq"], "left_semi")
        if rest.isEmpty():
            break
        key = F.col("seq").cast("string").alias("key")
        own = [x for x in ("t",) if x in reps.columns]
        gone = hits(rest.select("scope", key, "text", *own), fresh.select("scope", F.lit(1).alias("fresh"), "seq", "text", *own)).where(AGAINST).select("scope", F.col("key").cast("long").alias("seq"))
        if meant is not None:
            gone = gone.unionByName(meant.join(fresh.select("scope", F.col("seq").alias("earlier")), ["scope", "earlier"], "left_semi").select("scope", F.col("later").alias("seq")))
        reps = steps.keep(rest.join(gone.distinct(), ["scope", "seq"], "left_anti"))
        most *= 2
    return done if done is not None else reps


def prepared(rows: DataFrame) -> DataFrame:
    """project, seq, kind, scope, own (the reason that a record fails on its own), text, why, link; rows: project, seq, kind, data."""
    kind, data = F.col("kind"), F.col("data")
    link = F.coalesce(*[F.nullif(stripped(data[f]), F.lit("")) for f in ("supersedes_id", "chosen_decision_id")])
    more = ["embedding"] if "embedding" in rows.columns else []
    return rows.select("project", "seq", "kind", scope(kind, F.col("project")).alias("scope"), own_reason(kind, data).alias("own"), stripped(main_text(kind, data)).alias("text"),
                       stripped(data["why"]).alias("why"), link.alias("link"), *more)


def judge(known: DataFrame, held: DataFrame, one: str | None = None) -> DataFrame:
    """(project, seq, status, reason) of records against what is held, `held` being (scope, fresh, seq, text): the first rule that fails.

    Something held counts against a record only where it comes before it. known: what prepared() gives, with `linked`, whether
    the decision that a record names is there, or null where it names none; `one` is its text where it is a single row.
    """
    key = F.col("text") if "embedding" in known.columns else ascii_lower(F.col("text"))  # vectors may tell apart what case does
    known = known.withColumn("key", key)
    compared = known.where((F.col("kind") != "snapshot") & F.col("own").isNull())
    classes = compared.groupBy("scope", "key").agg(F.min("text").alias("text"), F.min("seq").alias("first"), *[F.first(x).alias(x) for x in ("t", "embedding") if x in known.columns])
    found = hits(classes, held) if one is None else hits_of_one(classes.drop("first"), held, one)
    before = lambda m: F.col(m).isNotNull() & (F.struct(F.col(f"{m}.fresh"), F.col(f"{m}.seq")) < F.struct(F.lit(1), F.col("seq")))
    out = known.join(found, ["scope", "key"], "left")
    name = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in NAMES.items()])
    against = lambda m: F.concat(F.lit("Contradicts existing decision: '"), F.substring(f"{m}.text", 1, 80), F.lit("'"))
    # The texts of reasons, from which categories are cut.
    reason = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("kind") == "snapshot", "ok")
        .when(before("exact"), F.concat(F.lit("Exact duplicate"), F.when(F.col("kind") == "open_task", " task").otherwise(""), F.lit(": '"), F.substring("text", 1, 60), F.lit("'")))
        .when(before("swap"), against("swap"))
        .when(before("meant"), against("meant"))
        .when(before("near.m"), F.concat(F.lit("Too similar to existing "), name, F.lit(" ("), F.floor(F.col("near.sim") * 100).cast("string"), F.lit("% match): '"), F.substring("near.m.text", 1, 70), F.lit("'")))
        .when((F.col("kind") == "decision") & (F.col("why") == ""), F.lit(NO_REASON))
        .when(~F.col("linked"), F.concat(F.lit("Referenced decision does not exist: '"), F.col("link"), F.lit("'")))
        .otherwise("ok")
    )
    status = F.when(F.col("reason").startswith("Unknown type") | F.col("reason").startswith("Referenced decision"), "rejected").when(F.col("reason") == "ok", "committed").otherwise("staged")
    return out.select("project", "seq", "kind", reason.alias("reason")).select("project", "seq", status.alias("status"), "reason")


def held_texts(existing: DataFrame) -> DataFrame:
    """(scope, fresh, seq, text) of records that are held."""
    more = ["embedding"] if "embedding" in existing.columns else []
    return existing.where(F.col("kind").isin(*NAMES)).select(scope(F.col("kind"), F.col("project")).alias("scope"), F.lit(0).alias("fresh"), "seq", stripped(main_text(F.col("kind"), F.col("data"))).alias("text"), *more)


def _accepted(known: DataFrame, held: DataFrame, needs: DataFrame, steps: Steps) -> DataFrame:
    """(scope, fresh, seq, text, t) of the records of a batch that are accepted and that later ones are judged by; known and held have `t`, what likes() gives."""
    vectors = "embedding" in known.columns
    more = ["t", *(["embedding"] if vectors else [])]
    fit = known.where(F.col("own").isNull() & F.col("kind").isin(*NAMES) & ((F.col("kind") != "decision") | (F.col("why") != "")) & F.coalesce("linked", F.lit(True)))
    fit = fit.select("scope", "seq", "text", "within", *more)
    # what one of a class stands against, all later ones do, so only the first can be accepted; not so for one that waits for another
    # record of the batch, for what vectors may tell apart, and for dead ends without tokens, which are no one's likes
    lone = F.col("within") | (F.col("scope").startswith("dead_end") & (F.size("t") == 0)) | F.lit(vectors)
    fit = fit.withColumn("class", F.when(lone, F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("="), ascii_lower(F.col("text")))))
    reps = steps.keep(fit.groupBy("scope", "class").agg(F.min(F.struct("seq", "text", *more)).alias("m")).select("scope", "m.*"))
    free = reps
    if not held.isEmpty():
        key = F.col("seq").cast("string").alias("key")
        gone = hits(reps.select("scope", key, "text", *more), held).where(AGAINST).select("scope", F.col("key").cast("long").alias("seq")).distinct()
        free = steps.keep(reps.join(gone, ["scope", "seq"], "left_anti"))
    meant = None
    if vectors:
        told = free.where("scope like 'decision%'").select(F.col("scope").alias("project"), F.col("seq").alias("id"), "seq", F.col("text").alias("what"), "embedding")
        meant = steps.keep(opposed_pairs(told, told).select(F.col("project").alias("scope"), F.col("id").alias("later"), F.col("other").alias("earlier")))
    return _greedy(steps, free, needs, meant).select("scope", F.lit(1).alias("fresh"), "seq", "text", *more)


def fold(new: DataFrame, existing: DataFrame, actions: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """(project, seq, status, reason) of a batch: each record against what the project held and what the batch added before it.

    new and existing: project, seq, kind, and a `data` map; seq tells the records of a project apart; existing holds what checks
    look at (all decisions, open tasks, dead ends). actions: (project, category, action). The accepted records are the first, in
    order, of a graph of what stands against what, found in rounds (see _greedy); nothing stands against these, and every other record is judged by them. Texts
    are read and told apart once, and what comes of it is written down. No project gathers in a task. Where new has `id`, links are followed: decisions holds the ids of decisions that there are, and a
    link may also name a decision of the same project that the batch has accepted before. Where new and existing have `embedding`,
    decisions are compared by meaning too.
    """
    steps = Steps(new.sparkSession)
    known, needs = prepared(new).withColumn("linked", F.lit(None).cast("boolean")).withColumn("within", F.lit(False)), None
    if "id" in new.columns:
        known = prepared(new).join(decisions.select(F.col("id").alias("link"), F.lit(True).alias("there")).distinct(), "link", "left")
        known = known.join(new.where("kind = 'decision'").select("project", F.col("id").alias("link"), F.col("seq").alias("nth")), ["project", "link"], "left")
        known = known.withColumn("nth", F.when(F.col("there").isNull() & (F.col("nth") < F.col("seq")), F.col("nth")))
        known = known.withColumn("within", F.col("nth").isNotNull()).withColumn("linked", F.when(F.col("link").isNotNull(), F.coalesce("there", F.lit(False)) | F.col("within")))
        known = known.drop("there")
    # of records that are compared; written once, as texts and their tokens are looked at from many sides
    known = steps.keep(known.withColumn("t", F.when(F.col("own").isNull() & F.col("kind").isin(*NAMES), likes(F.col("scope"), F.col("text")))))
    if "id" in new.columns:
        needs = known.where("within").select("scope", "seq", scope(F.lit("decision"), F.col("project")).alias("of"), "nth")
    else:
        needs = known.where("false").select("scope", "seq", F.col("scope").alias("of"), F.col("seq").alias("nth"))
    held = held_texts(existing).withColumn("t", likes(F.col("scope"), F.col("text")))
    taken = steps.keep(_accepted(known, held, needs, steps))
    if "id" in new.columns:
        met = taken.select(F.col("scope").alias("of"), F.col("seq").alias("nth"), F.lit(True).alias("met"))
        known = known.withColumn("of", scope(F.lit("decision"), F.col("project"))).join(met, ["of", "nth"], "left").withColumn("linked", F.when(F.col("within"), F.coalesce("met", F.lit(False))).otherwise(F.col("linked")))
    # an accepted record has nothing before it that stands against it
    known = known.join(taken.select("scope", "seq", "text", F.lit(True).alias("taken")).distinct(), ["scope", "seq", "text"], "left")
    accepted = known.where("taken").select("project", "seq", F.lit("committed").alias("status"), F.lit("ok").alias("reason"))
    judged = judge(known.where("taken is null").drop("taken"), held.unionByName(taken)).unionByName(accepted)
    return with_policy(judged, actions) if actions is not None else judged


def with_policy(judged: DataFrame, actions: DataFrame) -> DataFrame:
    """Staged records whose category is to be turned down at once are."""
    judged = judged.withColumn("category", category(F.col("reason"))).join(actions.select("project", "category", "action"), ["project", "category"], "left")
    auto = (F.col("status") == "staged") & (F.col("action") == "auto_reject")
    return judged.select("project", "seq", F.when(auto, "auto_rejected").otherwise(F.col("status")).alias("status"), "reason")
