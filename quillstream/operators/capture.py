"""Labels, capture modes and events that follow from a shell command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The label grammar and the programs it knows.
PRODUCT, VERSION, LONGEST, SEQ_ROOM = "ctx", "v1", 200, 13
READERS, SEARCHERS = ["cat", "head", "tail", "less", "more", "bat"], ["grep", "egrep", "fgrep", "rg", "ag"]
GIT_SUBCOMMANDS = ["diff", "status", "log", "show"]
CODE_SUFFIXES = "go py js ts tsx jsx java c h cpp hpp cc rs rb php cs kt swift scala sh sql proto".split()
SECRET_OPTIONS = ["password", "passwd", "token", "secret", "api-key", "api_key", "apikey"]
TRACE_BYTES = 512


def encoded(c: Column) -> Column:
    """A label segment with its reserved and control characters percent-encoded."""
    for char in "%:#@ ":
        c = F.replace(c, F.lit(char), F.lit(f"%{ord(char):02X}"))
    control = r"[\x00-\x1f\x7f]"
    each = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x))
    return F.when(c.rlike(control), F.array_join(each, "")).otherwise(c)


def short_hash(c: Column) -> Column:
    return F.concat(F.lit("h"), F.substring(F.sha2(c, 256), 1, 16))


def label(prefix: Column, ident: Column, room: int | Column = 0) -> Column:
    """prefix and identity segments joined by colons; too long, the identity becomes a hash, then the head is cut."""
    room = F.lit(LONGEST) - (F.lit(room) if isinstance(room, int) else room)
    whole = F.array_join(F.concat(prefix, ident), ":")
    hashed = F.array_join(F.concat(prefix, F.array(short_hash(F.array_join(ident, ":")))), ":")
    digest = short_hash(whole)
    cut = F.concat(F.substring(hashed, 1, LONGEST - SEQ_ROOM - 18), F.lit(":"), digest)
    return F.when(F.octet_length(whole) <= room, whole).when((F.size(ident) > 0) & (F.octet_length(hashed) <= room), hashed).otherwise(cut)


def normal_path(path: Column, cwd: Column, root: Column) -> Column:
    """A path relative to the root, its dots resolved; null if it leaves the root or has none."""
    base = F.coalesce(F.nullif(cwd, F.lit("")), root)
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))
    parts = F.filter(F.split(absolute, "/"), lambda x: ~x.isin("", "."))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    clean = F.concat(F.lit("/"), F.array_join(resolved, "/"))
    under = F.when(clean == root, F.lit(".")).when(clean.startswith(F.concat(root, F.lit("/"))), F.substring(clean, F.length(root) + 2, F.length(clean)))
    bare = F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")
    rootless = F.when(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), None).otherwise(F.when(bare == "", ".").otherwise(bare))
    return F.when(root.isNull(), rootless).otherwise(under)


def parsed(commands: DataFrame) -> DataFrame:
    """Adds program, subcommand, args and pipeline of `command`; assignments before the program are dropped."""
    tokens = F.transform(F.regexp_extract_all("command", F.lit(r"""((?:"[^"]*+"|'[^']*+'|[^\s"']++|["'])++)"""), F.lit(1)), lambda t: F.regexp_replace(t, "[\"']", ""))
    assigned = r"^[A-Za-z_][A-Za-z0-9_]*="
    first = F.filter(F.transform(tokens, lambda t, i: F.when(~t.rlike(assigned) & (t != "env"), i)), lambda i: i.isNotNull())
    kept = F.slice(tokens, F.coalesce(F.element_at(F.col("__first"), 1), F.size(tokens)) + 1, F.greatest(F.size(tokens), F.lit(1)))
    out = commands.withColumn("__first", F.when(F.size(first) > 0, first).otherwise(F.array(F.size(tokens)))).withColumn("__kept", kept)
    out = out.withColumns({
        "program": F.regexp_replace(F.coalesce(F.get("__kept", F.lit(0)), F.lit("")), "^.*/", ""),
        "args": F.when(F.size("__kept") > 1, F.slice("__kept", 2, F.greatest(F.size("__kept") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")),
        "pipeline": F.regexp_replace("command", r"""("[^"]*"|'[^']*')""", "").rlike(r"[|;&<>\n]|\$\(|`"),
    })
    sub = F.when(F.col("program") == "git", F.get("args", F.lit(0)))
    out = out.withColumn("subcommand", sub)
    return out.withColumn("args", F.when(sub.isNotNull(), F.slice("args", 2, F.greatest(F.size("args"), F.lit(1)))).otherwise(F.col("args"))).drop("__first", "__kept")


#: What a shell takes as one: escaped characters, quoted text, or any other character but the separators of commands; a lone & is none.
PIECE = r"""\\.|"(?:\\.|[^"\\])*"|'[^']*'|[^|;&\n"'\\]|&(?!&)"""


def segments(command: Column) -> Column:
    """The commands of a line, parted at pipes, `&&`, `;` and line breaks that aren't quoted; blank ones are left out."""
    cut = F.regexp_extract_all(command, F.lit(rf"((?:{PIECE})++)"), F.lit(1))
    return F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(x, r"^\s*&", ""))), lambda x: F.length(x) > 0)


def program_of(segment: Column) -> Column:
    """The base name of the program a single command runs; null if it has assignments only."""
    tokens = F.transform(F.regexp_extract_all(segment, F.lit(r"""((?:"[^"]*+"|'[^']*+'|[^\s"']++|["'])++)"""), F.lit(1)), lambda t: F.regexp_replace(t, "[\"']", ""))
    said = F.filter(tokens, lambda t: ~t.rlike(r"^([A-Za-z_][A-Za-z0-9_]*=.*|(.*/)?env)$"))
    return F.regexp_replace(F.get(said, F.lit(0)), "^.*/", "")


def programs(command: Column) -> Column:
    """The programs that a line runs, segment by segment."""
    return F.filter(F.transform(segments(command), program_of), lambda x: x.isNotNull())


def invokes(command: Column, program: str) -> Column:
    """Whether any segment of a line runs a program, in whatever case, with or without `.exe`."""
    return F.exists(programs(command), lambda x: F.lower(x).isin(program.lower(), program.lower() + ".exe"))


def plans(invocations: DataFrame) -> DataFrame:
    """Label, mode and content type of rows (command, cwd, root, workspace, seq, ...).

    mode: `replace` (the label names content that a later capture replaces),
    `dual` (a latest label and a history label with #seq) or `coexist`
    (history only: a pipeline, a command with flags, an unknown program, a
    path that leaves the root or holds a pattern).  Blank commands have no plan.
    """
    p = parsed(invocations.where(F.length(F.trim("command")) > 0))
    operands = F.filter("args", lambda a: ~a.startswith("-"))
    flagged = F.exists("args", lambda a: a.startswith("-") & (a != "--"))
    scoped = F.when(F.col("program").isin(SEARCHERS), F.slice(operands, 2, F.greatest(F.size(operands), F.lit(1)))).when(F.col("program").isin("ls", "find") & (F.size(operands) == 0), F.array(F.lit("."))).otherwise(operands)
    rel = F.transform(scoped, lambda x: F.when(x == "--", "--").otherwise(normal_path(x, F.col("cwd"), F.col("root"))))
    p = p.withColumns({"operands": operands, "rel": rel})
    sound = ~F.exists("rel", lambda x: x.isNull()) & ((F.col("program") == "git") | ~F.exists("rel", lambda x: F.coalesce(x, F.lit("")).rlike(r"[*?\[]")))
    reader = F.col("program").isin(READERS) & (F.size("operands") > 0)
    searcher = F.col("program").isin(SEARCHERS) & (F.size("operands") > 0)
    kind = F.when(F.col("pipeline") | flagged | ~sound, None).when((F.col("program") == "git") & F.col("subcommand").isin(GIT_SUBCOMMANDS), "git").when(reader, "read").when(F.col("program") == "ls", "list").when(searcher, "grep").when(F.col("program") == "find", "find")
    p = p.withColumn("kind", kind)
    domain = F.when(F.col("kind") == "git", "vcs").when(F.col("kind").isin("read", "list"), "file").when(F.col("kind").isin("grep", "find"), "search").otherwise("shell")
    context = F.when(F.col("kind") == "git", F.array(encoded(F.col("subcommand")))).when(F.col("kind") == "grep", F.array(encoded(F.get("operands", F.lit(0))))).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.transform("rel", encoded), lambda x: ~x.isin("", "."))
    program = F.array(F.when(F.col("pipeline") | (F.col("program") == ""), "sh").otherwise(encoded(F.col("program"))))
    ident = F.when(F.col("kind").isNull(), program).when((F.col("kind") == "git") & (F.size("operands") == 0) & (F.col("subcommand") != "status"), F.array(F.lit("HEAD"))).otherwise(own)
    verb = F.when(F.col("kind").isNotNull(), F.array(F.col("kind"))).otherwise(F.array().cast("array<string>"))
    space = F.when(F.length(F.coalesce("workspace", F.lit(""))) > 0, F.array(encoded(F.col("workspace")))).otherwise(F.array().cast("array<string>"))
    prefix = F.concat(F.array(F.lit(PRODUCT), F.lit(VERSION), domain), verb, space, context)
    mode = F.when(F.col("kind").isNull(), "coexist").when(F.col("kind") == "git", "dual").otherwise("replace")
    p = p.withColumns({"mode": mode, "prefix": prefix, "ident": ident})
    base = label(F.col("prefix"), F.col("ident"), F.when(F.col("mode") == "replace", 0).otherwise(SEQ_ROOM))
    history = F.concat(base, F.lit("#"), F.col("seq").cast("string"))
    suffix = F.lower(F.regexp_extract(F.get("operands", F.lit(0)), r"\.([^./]*)$", 1))
    code = (F.col("kind").eqNullSafe("git") & F.col("subcommand").isin("diff", "show")) | (F.col("kind").eqNullSafe("read") & suffix.isin(CODE_SUFFIXES))
    p = p.withColumns({
        "latest_source": F.when(F.col("mode") != "coexist", base), "history_source": F.when(F.col("mode") != "replace", history),
        "content_type": F.when(F.coalesce(code, F.lit(False)), "code").otherwise("prose"),
    })
    return p.drop("operands", "rel", "prefix", "ident")


def redacted(c: Column) -> Column:
    """A text without secrets and control characters: the word after `bearer`, and the value of an option that holds a secret."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    bearer, option = r"\bbearer", "|".join(SECRET_OPTIONS)
    c = F.regexp_replace(c, rf"(?i)({bearer})\s+[^\s]+", "$1 <redacted>")
    return F.regexp_replace(c, rf"(?i)(-{{1,2}}(?:{option}))(?:\s+|=)[^\s]+", "$1=<redacted>")


def whole_characters(raw: Column) -> Column:
    """Bytes as text, without what is left of a character that was cut."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def trace_tail(stderr: Column) -> Column:
    """The last 512 bytes of an error stream, redacted first; whole characters only."""
    clean = F.trim(redacted(F.trim(stderr)))
    tail = F.substring(F.encode(clean, "UTF-8"), -TRACE_BYTES, TRACE_BYTES)
    return F.trim(F.when(F.octet_length(clean) > TRACE_BYTES, whole_characters(tail)).otherwise(clean))


def events(planned: DataFrame) -> DataFrame:
    """Events of planned invocations (event_id, exit_code, interrupted, trace, ...): the call, an error with its trace, a git operation."""
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False)) | F.coalesce(F.col("interrupted"), F.lit(False))
    git = F.col("program") == "git"
    summary = F.trim(F.concat_ws(" ", "program", "subcommand"))
    made = F.filter(F.array(
        F.struct(F.lit("tool_invocation").alias("type"), F.lit(3).alias("priority"), F.lit(None).cast("string").alias("trace")),
        F.when(failed, F.struct(F.lit("error_observed").alias("type"), F.lit(2).alias("priority"), F.col("trace"))),
        F.when(git, F.struct(F.lit("git_operation").alias("type"), F.lit(2).alias("priority"), F.lit(None).cast("string").alias("trace"))),
    ), lambda e: e.isNotNull())
    return planned.select("event_id", "seq", summary.alias("command"), "exit_code", "latest_source", "history_source", F.explode(made).alias("e")).select("*", "e.type", "e.priority", F.col("e.trace").alias("trace_snippet")).drop("e")


def parsed_labels(labels: Column) -> Column:
    """base, seq and token of a label `base[#seq][@token]`."""
    token = F.nullif(F.regexp_extract(labels, r"@([a-z2-7]{6})$", 1), F.lit(""))
    rest = F.regexp_replace(labels, r"@[a-z2-7]{6}$", "")
    seq = F.regexp_extract(rest, r"#(\d+)$", 1)
    return F.struct(F.regexp_replace(rest, r"#\d+$", "").alias("base"), F.nullif(seq, F.lit("")).try_cast("long").alias("seq"), token.alias("token"))


# ---- what a command shows ----------------------------------------------------------

#: Bytes shown whole, bytes of a failure shown whole, of its head.
INLINE_MOST, FAILURE_MOST, FAILURE_HEAD = 4096, 16_384, 4096


def payload(stdout: Column, stderr: Column) -> Column:
    """Both streams as one text: each under its mark if both hold something, a blank error stream left out."""
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    marked = F.concat(F.lit("[stderr]\n"), err)
    gap = F.when(out.endswith("\n"), "\n").otherwise("\n\n")
    both = F.concat(F.lit("[stdout]\n"), out, gap, marked)
    told = F.length(F.regexp_replace(err, r"\s+", "")) > 0
    return F.when(told & (out != ""), both).when(told, marked).otherwise(out)


def presentation(text: Column, failed: Column) -> Column:
    """How a payload is shown: inline, whole or cut failure, or as a compact summary."""
    size = F.octet_length(text)
    return F.when(size <= INLINE_MOST, "inline").when(failed & (size <= FAILURE_MOST), "failure").when(failed, "failure_cut").otherwise("compact")


def shown(text: Column, failed: Column) -> Column:
    """The payload as it is shown: whole, or of a long failure its first 4,096 and last 12,288 bytes (whole characters) around a line that tells what was left out; null where only a summary is."""
    raw = F.encode(text, "UTF-8")
    head, tail = whole_characters(F.substring(raw, 1, FAILURE_HEAD)), whole_characters(F.substring(raw, -(FAILURE_MOST - FAILURE_HEAD), FAILURE_MOST - FAILURE_HEAD))
    gap = F.concat(F.when(head.endswith("\n"), "").otherwise("\n"), F.lit("["), (F.octet_length(text) - FAILURE_MOST).cast("string"), F.lit(" bytes left out]\n"))
    mode = presentation(text, failed)
    return F.when(mode.isin("inline", "failure"), text).when(mode == "failure_cut", F.concat(head, gap, tail))


def single_line(text: Column) -> Column:
    """A text on one line, runs of blanks as one."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_session_id(ident: Column) -> Column:
    """A session id that can name a folder: as it is, if short and of lower-case letters, digits, _ and -, else its hash."""
    return F.when(ident.rlike(r"^[a-z0-9_-]{1,128}$"), ident).otherwise(F.sha2(ident, 256))


def workspace_ids(seen: DataFrame, path: str, order: str) -> DataFrame:
    """(path, workspace): the last part of each path; of several paths that end alike all but the one seen first get eight digits of their hash."""
    first = seen.where(F.length(F.coalesce(path, F.lit(""))) > 0).groupBy(F.col(path).alias("path")).agg(F.min(order).alias("first"))
    named = first.withColumn("base", F.regexp_extract("path", "([^/]*)/*$", 1))
    winners = named.groupBy("base").agg(F.min(F.struct("first", "path"))["path"].alias("winner"))
    joined = named.join(winners, "base")
    ident = F.when(F.col("path") == F.col("winner"), F.col("base")).otherwise(F.concat("base", F.lit("-"), F.substring(F.sha2("path", 256), 1, 8)))
    return joined.select("path", ident.alias("workspace"))


#: Entries and bytes of an inventory, bytes of its heading and of what stands around an entry.
INVENTORY_ENTRIES, INVENTORY_BYTES, HEADING_BYTES, ENTRY_BYTES = 20, 1024, 59, 8


def inventory(seen: DataFrame, group: str, source: str, order: str) -> DataFrame:
    """(group, source, last, position): the sources of each group seen last, at most 20 and as many as fit 1,024 bytes as lines under a heading.

    Lines are cut whole: the first one that doesn't fit ends the list.
    """
    last = seen.groupBy(group, F.col(source).alias("source")).agg(F.max(order).alias("last"))
    newest = Window.partitionBy(group).orderBy(F.col("last").desc(), "source")
    first = last.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= INVENTORY_ENTRIES)
    used = F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + ENTRY_BYTES).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("__used", used).where(F.col("__used") <= INVENTORY_BYTES - HEADING_BYTES).drop("__used")


def line_range(text: Column, start: int = 0, end: int = 0) -> Column:
    """Lines start to end of a text, from 1 and both included; 0 is the begin or the end; null if start lies past the last line."""
    lines = F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))
    if start <= 1 and end == 0:
        return text
    first = max(start, 1)
    count = F.size(lines) - first + 1 if end == 0 else F.lit(max(end - first + 1, 0))
    return F.when(F.size(lines) >= first, F.array_join(F.slice(lines, first, count), ""))
