"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

Every row is a symbol: its role's initial (s, u, a, or x for any other; in capitals where its text is truncated), or
`-` where it must go (blank or duplicate). A symbol is a min-plus matrix over the four places in the grammar (start,
after system, after user, after assistant): the cheapest edits, inserts before the row included, that lead from one
place to another, with their audit letters (K keep, R rerole, D delete, I insert). Matrices multiply by adding costs and
joining audits; ties go to the ASCII-least audit. That order survives joining: from one place an audit decides what it
leads to, so of two audits of one entry neither begins the other unless its cost is larger.

1. Rows are sorted by ranges of (conversation, turn) over all tasks and cut into blocks of `BLOCK` rows, so a
   conversation of any length is spread out. A block is a string of symbols.
2. Re-Pair over all distinct block strings: the most frequent neighbours become a new symbol, and again, up to `RULES`
   rules. A round counts pairs with one aggregate (at most symbols² rows leave it).
3. A rule's matrix is the product of its two symbols' matrices, evaluated bottom-up, once for all conversations. Its
   audits are ropes: two references to the parts' audits, spelled out when a block's matrix is stored. A block is the
   product of its few remaining symbols; equal strings of a batch share it.
4. A conversation of several blocks joins them sixteen at a time in a tree.
5. Rows meet their conversation's audit in order, in one stream per task (`repaired_rows`, or hashed row by row).

A SHA-256 over a conversation needs its rows in order, so step 5 streams one conversation through one task; it holds
one Arrow batch and one audit, never the conversation.

Edge cases: null roles and texts read as one space, null turns come first, a null conv_id is a conversation of its own;
rows of one turn go by role, then by the SHA-256 of their text; roles are told apart by their first character, and by
the whole for duplicates; conversations without rows have cost 0 and an empty audit; an empty table works; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import numbered, table

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
TO_USER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}     # where an inserted or reroled row leads
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
NAME = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GONE = "-"
BLOCK = 64
RULES = 64
FAN_IN = 16
FIRST_RULE = 0xE000                 # rules are characters of the private use area
MEMO = 20_000
OUT_ROWS = 1024
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

# An audit is a letter string or a rope, a pair of audits; a matrix is {(from, to): (cost, audit)}.


def letters(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += [top[1], top[0]]
        else:
            yield from top


def _less(a, b) -> bool:
    """(cost, audit) a before b."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y = letters(a[1]), letters(b[1])
    for p in x:
        q = next(y, "")
        if p != q:
            return p < q
    return next(y, None) is not None


def product(left: dict, right: dict) -> dict:
    out: dict = {}
    for (p, r), (c, x) in left.items():
        for q in range(4):
            if (r, q) in right:
                d, y = right[r, q]
                got = (c + d, (x, y) if x and y else x or y)
                if (p, q) not in out or _less(got, out[p, q]):
                    out[p, q] = got
    return out


def _inserts() -> dict:
    """No insert, one, or two from each place (more only go round)."""
    out = {(p, p): (0, "") for p in range(4)}
    for p in range(4):
        one = TO_USER[p]
        two = TO_USER[one]
        out.setdefault((p, one), (INSERT, "I"))
        out.setdefault((p, two), (2 * INSERT, "II"))
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> dict:
    """Inserts, then the edit of the row."""
    acts = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != GONE:
        extra = TRUNCATED if symbol.isupper() else 0
        for p in range(4):
            acts[p, TO_USER[p]] = (REROLE + extra, "R")
        for p, q in KEPT[symbol.lower()].items():
            acts[p, q] = (extra, "K")
    return product(INSERTS, acts)


TERMINALS = {c: symbol_matrix(c) for c in "suaxSUAX" + GONE}


def rule_matrices(rules: list[str]) -> dict[str, dict]:
    """Matrices of all symbols: the terminals', and each rule's (a string of two symbols) from its parts'."""
    out = dict(TERMINALS)
    for i, pair in enumerate(rules):
        out[chr(FIRST_RULE + i)] = product(out[pair[0]], out[pair[1]])
    return out


def packed(matrix: dict) -> str:
    """The 16 entries as cost:audit, comma-joined, empty where there is no way."""
    return ",".join(f"{matrix[p, q][0]}:{''.join(letters(matrix[p, q][1]))}" if (p, q) in matrix else ""
                    for p in range(4) for q in range(4))


def unpacked(text: str) -> dict:
    out = {}
    for i, entry in enumerate(text.split(",")):
        if entry:
            cost, audit = entry.split(":")
            out[divmod(i, 4)] = (int(cost), audit)
    return out


def best(matrix: dict) -> tuple[int, str]:
    """Cost and audit of the whole conversation whose rows' matrix this is."""
    whole = product(matrix, INSERTS)
    found = None
    for q in ACCEPTED:
        if (START, q) in whole and (found is None or _less(whole[START, q], found)):
            found = whole[START, q]
    return found[0], "".join(letters(found[1]))


def compressed(text: Column, rules: list[str]) -> Column:
    """A symbol string with each rule applied, in the order they were found."""
    for i, pair in enumerate(rules):
        text = F.replace(text, F.lit(pair), F.lit(chr(FIRST_RULE + i)))
    return text


def re_pair(strings: DataFrame, rules: int = RULES) -> list[str]:
    """Re-Pair rules over `strings` (seq, n): n counts a distinct string. A round takes the most frequent pair, and
    with it the next ones that share no symbol with those taken, as they can't change each other's counts. It ends
    when no pair occurs twice."""
    found: list[str] = []
    while len(found) < rules:
        now = strings.select(compressed(F.col("seq"), found).alias("s"), "n").where(F.length("s") > 1)
        pairs = now.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1),
                                                 lambda i: F.substr("s", i, F.lit(2)))).alias("pair"), "n")
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair")
        taken: set[str] = set()
        fresh = []
        for r in counts.collect():                          # symbols² rows at most
            if not taken & set(r["pair"]) and len(found) + len(fresh) < rules:
                fresh.append(r["pair"])
                taken |= set(r["pair"])
        if not fresh:
            break
        found += fresh
    return found


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a test bed for repair. Each row's CRC-32 of `conv_id:turn` modulo 20 drops it (0),
    empties its text (1), takes its sentence ends (2), repeats it (3) or makes it the user's (4)."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("code"))
    code = F.col("code")
    text = (F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return (rows.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                        text.alias("text"), F.explode(F.array_repeat(F.lit(True), copies)).alias("one")).drop("one"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _prepared(rows: DataFrame) -> DataFrame:
    """Stored rows (conv_id, turn, role, text, digest, row): `row` tells equal rows apart."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"))
    return table(rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("row", F.monotonically_increasing_id()),
                 "repair-rows")


def _judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, row, kind, fault): without texts from here on."""
    tail = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "role", "digest", "row",
                         F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("kind"),
                         (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # a text repeated without end is one partial row per task
    first = (narrow.groupBy("conv_id", "role", "digest")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "row")).alias("f"))
             .select(F.col("f.row").alias("first_row")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first_row").isNull(), "duplicate")
             .when(F.col("open"), "truncated"))
    return narrow.join(first, F.col("row") == F.col("first_row"), "left").select(
        "conv_id", "turn", "role", "digest", "row", "kind", fault.alias("fault"))


ORDER = ["conv_id", "turn", "role", "digest", "row"]       # ascending, nulls first


def block_strings(judged: DataFrame) -> DataFrame:
    """(conv_id, block, seq, illegal): the symbols of each block's rows of a conversation, and how many neighbours
    break the role order. The row after a block counts as its neighbour."""
    order = [F.asc_nulls_first(c) for c in ORDER]
    rows = numbered(judged, order, "repair-order")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE))
              .when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind")))
    block = F.shiftright("__at", BLOCK.bit_length() - 1)
    own = F.struct(block.alias("block"), symbol.alias("symbol"))
    peek = F.struct((block - 1).alias("block"), F.lit("").alias("symbol"))
    both = F.when(F.col("__at") % BLOCK == 0, F.array(peek, own)).otherwise(F.array(own))
    dealt = rows.select("conv_id", "__at", "kind", F.explode(both).alias("b")).select("conv_id", "__at", "kind", "b.*")
    item = F.sort_array(F.collect_list(F.struct("__at", "kind", "symbol")))          # BLOCK + 1 rows at most
    strings = dealt.groupBy("conv_id", "block").agg(item.alias("items")).select(
        "conv_id", "block", F.array_join("items.symbol", "").alias("seq"), F.array_join("items.kind", "").alias("kinds"))
    legal = F.regexp_count("kinds", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    return strings.where("seq <> ''").select(
        "conv_id", "block", "seq", (F.length("kinds") - 1 - legal).cast("long").alias("illegal"))


def _matrices(blocks: DataFrame, rules: list[str]) -> DataFrame:
    """`blocks` with `m`, each block's packed matrix."""
    known = rule_matrices(rules)

    @F.pandas_udf("string")
    def evaluate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, str] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            for text in set(batch) - memo.keys():
                whole = known[text[0]]
                for c in text[1:]:
                    whole = product(whole, known[c])
                memo[text] = packed(whole)
            yield batch.map(memo)

    return blocks.withColumn("m", evaluate(compressed(F.col("seq"), rules)))


def _joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Products of lists of packed matrices."""
    for batch in batches:
        out = []
        for parts in batch:
            whole = unpacked(parts[0])
            for part in parts[1:]:
                whole = product(whole, unpacked(part))
            out.append(packed(whole))
        yield pd.Series(out, dtype=object)


def _best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [best(unpacked(m)) for m in batch]
        yield pd.DataFrame({"cost": pd.Series([c for c, _ in got], dtype="int64"),
                            "audit": pd.Series([a for _, a in got], dtype=object)})


def audits(blocks: DataFrame, rules: int = RULES) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation of the stored `blocks`."""
    strings = table(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "repair-strings")
    now = table(_matrices(blocks, re_pair(strings, rules)).select("conv_id", "block", "illegal", "m"), "repair-matrices")
    spans = now.groupBy("conv_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1"),
                                       F.sum("illegal").alias("illegal"))
    spans = table(spans, "repair-spans")
    long = spans.where("b0 < b1").select(F.col("conv_id").alias("c"), "b0")
    one = now.join(spans.where("b0 < b1").select(F.col("conv_id").alias("c")), _same(F.col("conv_id"), F.col("c")),
                   "left_anti").select("conv_id", "m")
    widest = spans.agg(F.max(F.col("b1") - F.col("b0"))).first()[0] or 0
    tree = now.join(long, _same(F.col("conv_id"), F.col("c"))).select("conv_id", (F.col("block") - F.col("b0")).alias("at"), "m")
    while widest > 0:
        tree = tree.groupBy("conv_id", F.shiftright("at", FAN_IN.bit_length() - 1).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("at", "m"))).alias("parts"))          # FAN_IN at most
        tree = table(tree.select("conv_id", F.col("up").alias("at"), F.pandas_udf(_joined, "string")("parts.m").alias("m")), "repair-tree")
        widest //= FAN_IN
    done = one.unionByName(tree.select("conv_id", "m"))
    costs = done.select("conv_id", F.pandas_udf(_best, "cost long, audit string")("m").alias("x")).select(F.col("conv_id").alias("c"), "x.*")
    return spans.join(costs, _same(F.col("conv_id"), F.col("c"))).select("conv_id", "illegal", "cost", "audit")


def facts(judged: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated)."""
    def n(fault):
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    wide = "decimal(20,0)"
    gaps = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn").cast(wide)
    most = F.lit((1 << 63) - 1).cast(wide)
    return judged.groupBy("conv_id").agg(F.least(F.coalesce(gaps, F.lit(0).cast(wide)), most).cast("long").alias("gaps"),
                                         n("blank"), n("duplicate"), n("truncated"))


def _edited(role: str, text: str, edits: Iterator[str], place: int) -> tuple[list[tuple[str, str]], int]:
    """What one row becomes, with inserts before it; the place after it."""
    out = []
    for letter in edits:
        if letter == "I":
            place = TO_USER[place]
            out.append((NAME[place], ""))
        elif letter == "D":
            return out, place
        elif letter == "R":
            place = TO_USER[place]
            return [*out, (NAME[place], text)], place
        else:
            place = KEPT[role[:1]][place]
            return [*out, (role, text)], place
    return out, place


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, tuple[str, str] | None]]:
    """(head, (role, text)) for every repaired row in order, and (head, None) at the end of its conversation. A head
    row starts a conversation, its rows follow."""
    head, edits, place = None, iter(""), START
    for batch in batches:
        columns = batch.to_pydict()
        for values in zip(*columns.values(), strict=True):
            row = dict(zip(columns, values, strict=True))
            if row["is_row"]:
                lines, place = _edited(row["role"], row["text"], edits, place)
                yield from ((head, line) for line in lines)
            else:
                if head is not None:
                    yield from ((head, (NAME[p], "")) for p in _rest(edits, place))
                    yield head, None
                head, edits, place = row, iter(row["audit"]), START
    if head is not None:
        yield from ((head, (NAME[p], "")) for p in _rest(edits, place))
        yield head, None


def _rest(edits: Iterator[str], place: int) -> Iterator[int]:
    """Places of the inserts after the last row."""
    for _ in edits:
        place = TO_USER[place]
        yield place


def repair(rows: DataFrame, ids: DataFrame | None = None, rules: int = RULES) -> tuple[DataFrame, DataFrame]:
    """(summary, stream) of conversation rows (conv_id, turn, role, text): `summary` has a row per conversation of
    `ids` (default: of `rows`) with gaps, blank, duplicate, truncated, illegal, cost and audit; `stream` is its rows and
    the rows to edit, by conversation and in order, as `repaired_rows` and `repaired_hashes` read them."""
    stored = _prepared(rows)
    judged = table(_judged(stored), "repair-judged")
    blocks = table(block_strings(judged), "repair-blocks")
    ids = (stored if ids is None else ids).select(F.col("conv_id").alias("conv")).distinct()
    known = facts(judged).withColumnRenamed("conv_id", "f").join(
        audits(blocks, rules), _same(F.col("f"), F.col("conv_id"))).drop("f")
    summary = table(ids.join(known, _same(F.col("conv"), F.col("conv_id")), "left").select(
        F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit")), "repair-summary")
    heads = summary.withColumn("is_row", F.lit(False))
    stream = heads.unionByName(stored.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER[1:]).drop("digest", "row")
    return summary, stream


def _written(make, batches: Iterator[pa.RecordBatch], columns: dict[str, pa.DataType | None]) -> Iterator[pa.RecordBatch]:
    """Tuples of make(batches) as record batches; a column without a type has that of the input column."""
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([(c, first.schema.field(c).type if kind is None else kind) for c, kind in columns.items()])
    made = make(chain([first], batches))
    while rows := list(islice(made, OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                         schema=schema)


def repaired_hashes(stream: DataFrame) -> DataFrame:
    """The summary columns plus repaired_sha256: of the repaired rows as `role:text`, joined by line feeds."""
    columns = ["conv_id", *NUMBERS, "audit"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sha, before = hashlib.sha256(), ""
        for head, line in _edits(batches):
            if line:
                sha.update(f"{before}{line[0]}:{line[1]}".encode())
                before = "\n"
            else:
                yield (*[head[c] for c in columns], sha.hexdigest())
                sha, before = hashlib.sha256(), ""

    kinds = {**dict.fromkeys(columns), "repaired_sha256": pa.string()}
    return stream.mapInArrow(lambda batches: _written(hashes, batches, kinds),
                             stream.select(*columns).schema.add("repaired_sha256", "string"))


def repaired_rows(stream: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, rows counted from 0."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for head, line in _edits(batches):
            if line:
                yield (head["conv_id"], place, *line)
            place = place + 1 if line else 0

    kinds = {"conv_id": None, "place": pa.int64(), "role": pa.string(), "text": pa.string()}
    return stream.mapInArrow(lambda batches: _written(rows, batches, kinds),
                             stream.select("conv_id").schema.add("place", "long").add("role", "string").add("text", "string"))
