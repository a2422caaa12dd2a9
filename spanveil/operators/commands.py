"""Risk of shell commands: a tokeniser in an Arrow function, everything after it as expressions on arrays of words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wrappers, tools, flags, markers, severities.
WRAPPERS = "sudo doas env nice nohup ionice setsid sh bash zsh dash busybox".split()
ARCHIVERS = "tar gtar bsdtar zip 7z 7za 7zr rar gzip pigz bzip2 pbzip2 xz pxz zstd zpaq cpio shar makeself compress-archive".split()
EGRESS = "curl wget nc ncat netcat socat scp sftp rsync ssh ftp lftp tftp telnet rclone gsutil aws az gcloud huggingface-cli hf ngrok cloudflared".split()
FETCHERS = ["curl", "wget"]
SENDERS = "scp sftp rsync ssh nc ncat netcat socat ftp lftp tftp telnet rclone ngrok cloudflared huggingface-cli hf".split()
BODY_FLAGS = "--upload-file --data --data-raw --data-binary --data-urlencode --form --form-string --json --post-data --post-file --body-data --body-file".split()
DESTROYERS = "rm shred dd truncate wipefs mkfs mkfs.ext4 mkfs.xfs mkfs.btrfs fdisk parted".split()
SCANNERS = "rg ag ack grep tree".split()
MARKERS = ".ssh id_rsa id_ed25519 id_ecdsa id_dsa .aws/credentials .aws/config .gnupg .netrc .npmrc .pypirc .pgpass .my.cnf .docker/config.json .kube/config .git-credentials .config/gcloud .bash_history .zsh_history credentials.json service-account.json serviceaccount.json .env secrets.yaml secrets.yml /etc/shadow".split()
SEVERITY = {"archive": 0.6, "archive_whole": 0.9, "credential": 0.9, "bulk_read": 0.6, "network_egress": 0.6, "destructive": 0.9, "exfil": 0.95}
BANDS = {"block": 0.85, "review": 0.55, "redact": 0.30}
LEAST_CONFIDENCE = 0.5
DEPTH = 2
_WORDS = T.ArrayType(T.ArrayType(T.StringType()))

_LEX = re.compile(r"""(?P<single>'[^']*'?)|(?P<double>"(?:\\.|[^"\\])*\\?"?)|(?P<escaped>\\(?:.|\Z))|(?P<blank>[ \t\r]+)|(?P<end>[\n;]|&&?|\|\|?|>[>&]?|<[<&]?)|(?P<plain>[^'"\\ \t\r\n;&|<>]+)""", re.DOTALL)


def split_commands(line: str) -> list[list[str]]:
    """Commands of a line as lists of words, quotes and escapes resolved."""
    out: list[list[str]] = [[]]
    word: list[str] | None = None
    for m in _LEX.finditer(line):
        kind, raw = m.lastgroup, m[0]
        if kind in ("blank", "end"):
            if word is not None:
                out[-1].append("".join(word))
            word = None
            if kind == "end":
                out.append([])
            continue
        word = [] if word is None else word
        if kind == "single":
            word.append(raw[1:-1] if len(raw) > 1 and raw.endswith("'") else raw[1:])
        elif kind == "double":
            closed = len(raw) > 1 and raw.endswith('"') and not re.search(r'(?<!\\)(?:\\\\)*\\"$', raw)
            word.append(re.sub(r"\\(.)", r"\1", raw[1 : -1 if closed else None], flags=re.DOTALL))
        else:
            word.append(raw[1:] if kind == "escaped" else raw)
    if word is not None:
        out[-1].append("".join(word))
    return [c for c in out if c]


def is_assignment(word: str) -> bool:
    return re.match(r"[0-9A-Za-z_]+=", word) is not None


def expand_commands(line: str, depth: int = 0) -> list[list[str]]:
    """Commands without their wrappers; what a wrapper is given by -c is a line of its own, to two levels."""
    out = []
    for words in split_commands(line):
        rest, inner = words, None
        while rest and rest[0].lower() in WRAPPERS and inner is None:
            rest = rest[1:]
            while rest and rest[0].startswith("-") and inner is None:
                if rest[0] in ("-c", "--command"):
                    inner = rest[1] if len(rest) > 1 else ""
                rest = rest[1:]
            while rest and inner is None and is_assignment(rest[0]):
                rest = rest[1:]
        if inner:
            out += expand_commands(inner, depth + 1) if depth < DEPTH else []
        elif inner is None and rest:
            out.append(rest)
    return out


@F.pandas_udf(_WORDS)
def words_of(line: pd.Series) -> pd.Series:
    return line.fillna("").map(split_commands)


@F.pandas_udf(_WORDS)
def commands_of(line: pd.Series) -> pd.Series:
    return line.fillna("").map(expand_commands)


def command_line(command: Column, argv: Column, target: Column) -> Column:
    """The command, else the joined words, else the target."""
    return F.coalesce(F.nullif(command, F.lit("")), F.nullif(F.array_join(argv, " "), F.lit("")), target, F.lit(""))


def first_word(commands: Column) -> Column:
    return F.coalesce(F.get(F.get(commands, F.lit(0)), F.lit(0)), F.lit(""))


def has_indirection(commands: Column) -> Column:
    """A head that the shell computes: a variable, an assignment, eval and its like."""
    head = lambda c: F.get(c, F.lit(0))
    return F.exists(commands, lambda c: head(c).rlike("[$`]") | (head(c).contains("=") & ~head(c).startswith("-") & ~head(c).contains("://")) | head(c).isin("eval", "exec", "source", "."))


def _signals(line: Column, commands: Column, file_count: Column, hosts: list[str]) -> dict[str, Column]:
    low = F.lower(line)
    head = lambda c: F.lower(F.get(c, F.lit(0)))
    word = lambda c, i: F.lower(F.coalesce(F.get(c, F.lit(i)), F.lit("")))
    args = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    any_arg = lambda c, f: F.exists(args(c), f)
    some = lambda f: F.exists(commands, f)

    def packs(c: Column) -> Column:
        unpacks = (head(c).isin("7z", "7za", "7zr", "rar") & word(c, 1).isin("x", "e", "l", "t")) | any_arg(c, lambda a: F.lower(a).rlike("^--(?:extract|list|to-stdout|get)") | F.lower(a).rlike("^-(?!-)(?!.*c).*[xt]"))
        return head(c).isin(*ARCHIVERS) & ~unpacks

    git_archive = lambda c: (head(c) == "git") & (word(c, 1) == "archive")
    whole = lambda a: ~(a.startswith("-") & ~a.contains("/")) & (F.rtrim(a, F.lit("/")).isin("", ".", "..", "~", "*", "$pwd", "${pwd}") | a.startswith("~/"))
    bare_method = lambda m: F.upper(F.trim(m)).isin("POST", "PUT", "PATCH")

    def carries(c: Column) -> Column:
        """A fetcher given something to send."""
        flagged = any_arg(c, lambda a: F.lower(a).rlike("^(?:" + "|".join(BODY_FLAGS) + ")(?:=|$)") | (F.lower(a).startswith("--request=") & bare_method(F.substring(a, 11, 99))))
        short = (head(c) == "curl") & any_arg(c, lambda a: a.rlike("^-(?!-).*[TdF]") | (a.rlike("^-[^-]*X.") & bare_method(F.regexp_extract(a, "^-[^X]*X(.*)$", 1))))
        pairs = F.zip_with(args(c), F.slice(args(c), 2, F.greatest(F.size(args(c)), F.lit(1))), lambda a, b: F.coalesce(((F.lower(a) == "--request") | (a.rlike("^-(?!-)[^X]*X$") & (head(c) == "curl"))) & bare_method(b), F.lit(False)))
        return head(c).isin(*FETCHERS) & (flagged | short | F.exists(pairs, lambda x: x))

    operand = lambda c: any_arg(c, lambda a: ~a.startswith("-"))
    substituted = low.contains("$(") | low.contains("${") | low.contains("`")
    url_host = lambda a: F.regexp_extract(a, r"^(?:(?i)https?|ftp)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    at_host = lambda a: F.regexp_extract(a, r"@([^@:]+):[^@]*$", 1)
    named = F.flatten(F.transform(commands, lambda c: F.filter(F.transform(args(c), lambda a: F.when(a.startswith("-"), F.lit("")).when(url_host(a) != "", url_host(a)).otherwise(at_host(a))), lambda h: h != "")))
    host = F.coalesce(F.get(named, F.lit(0)), F.lit(""))
    trusted = F.lit(False)
    for pattern in hosts:
        trusted = trusted | (F.lower(host).endswith(pattern.lower()) if pattern.startswith(".") else F.lower(host) == pattern.lower())
    talks = some(lambda c: head(c).isin(*EGRESS))
    fetches = ~substituted & ~some(lambda c: head(c).isin(*[t for t in EGRESS if t not in FETCHERS])) & ~some(carries) & some(lambda c: head(c).isin(*FETCHERS))
    pushes = some(
        lambda c: ((head(c) == "git") & (word(c, 1) == "push"))
        | (head(c).isin("docker", "podman") & (word(c, 1) == "push"))
        | (head(c).isin("npm", "pnpm", "yarn") & (word(c, 1) == "publish"))
        | ((head(c) == "gsutil") & word(c, 1).isin("cp", "rsync"))
        | ((head(c) == "huggingface-cli") & (word(c, 1) == "upload"))
        | ((head(c) == "aws") & (word(c, 1) == "s3") & word(c, 2).isin("cp", "sync", "mv"))
    )
    unseen = some(carries) | (substituted & some(lambda c: head(c).isin(*FETCHERS) & operand(c))) | some(lambda c: head(c).isin(*SENDERS) & operand(c))
    heads = F.transform(commands, head)
    assigned = F.array_join(F.transform(F.filter(commands, lambda c: F.get(c, F.lit(0)).rlike("^(?!-)[^=:]+=")), lambda c: F.regexp_extract(F.get(c, F.lit(0)), "=(.*)$", 1)), " ")
    loose = F.split(F.concat_ws(" ", low, F.lower(assigned)), "[ ;=\"'\n\t]+")
    hidden = F.exists(loose, lambda w: w.isin(*ARCHIVERS, *EGRESS, *DESTROYERS) & ~F.array_contains(heads, w))
    walks = some(
        lambda c: ((head(c) == "find") & ~F.exists(c, lambda a: F.lower(a).isin("-maxdepth", "--max-depth", "-depth")))
        | (head(c).isin(*SCANNERS) & any_arg(c, lambda a: F.lower(a).rlike("^-r|^-nr$|^--recursive|^-g$|^--files$")))
    )
    destroys = some(
        lambda c: head(c).isin(*DESTROYERS)
        & any_arg(
            c,
            lambda a: F.lower(a).isin("-r", "-rf", "-fr", "--force", "-f")
            | F.lower(a).startswith("--recursive")
            | ((head(c) == "dd") & F.lower(a).startswith("of=/dev/"))
            | (head(c).isin("rm", "shred") & (a.isin("/", "/*", "*") | a.startswith("~"))),
        )
    ) | some(lambda c: (F.size(c) >= 3) & (head(c) == "git") & (((word(c, 1) == "reset") & (word(c, 2) == "--hard")) | ((word(c, 1) == "clean") & F.exists(F.slice(c, 3, F.size(c)), lambda a: a.rlike("^-.*[fdx]")))))
    packing = some(packs)
    return {
        "packs": packing,
        "packs_whole": some(lambda c: (packs(c) | git_archive(c)) & any_arg(c, whole)),
        "git_archive": some(git_archive),
        "hidden": hidden,
        "credential": F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(low, m)),
        "bulk_read": low.rlike(r"\.git(?:[/\\\"' *;|&]|$)") | walks | (F.coalesce(file_count, F.lit("")) != ""),
        "egress": F.when(talks, F.when(host != "", ~trusted & ~fetches).otherwise(pushes)).otherwise(pushes),
        "fetch": talks & (host != "") & ~trusted & fetches,
        "unseen": talks & (host == "") & ~pushes & unseen,
        "destructive": destroys,
    }


def judge(actions: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """(line[, file_count]) with category and severity: the hit of the highest severity, the first of equals.

    Without a hit an action is benign; an empty line is unknown.
    """
    count = F.col("file_count") if "file_count" in actions.columns else F.lit(None).cast("string")
    parsed = actions.withColumn("__commands", commands_of(F.col("line")))
    s = _signals(F.coalesce(F.col("line"), F.lit("")), F.col("__commands"), count, hosts or [])
    parsed = parsed.withColumn("__s", F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in s.items()]))
    on = lambda k: F.col("__s")[k]
    archive = on("packs") | on("git_archive")
    hit = lambda test, kind, level: F.when(test, F.struct(F.lit(kind).alias("category"), F.lit(level).alias("severity")))
    hits = F.array(
        hit(on("packs") & on("packs_whole"), "archive", SEVERITY["archive_whole"]),
        hit((on("packs") & ~on("packs_whole")) | (~on("packs") & on("git_archive")), "archive", SEVERITY["archive"]),
        hit(~archive & on("hidden"), "unknown", 0.0),
        hit(on("credential"), "credential", SEVERITY["credential"]),
        hit(on("bulk_read"), "bulk_read", SEVERITY["bulk_read"]),
        hit(on("fetch"), "benign", 0.0),
        hit(on("egress"), "network_egress", SEVERITY["network_egress"]),
        hit(on("unseen"), "unknown", 0.0),
        hit(on("destructive"), "destructive", SEVERITY["destructive"]),
        hit(archive & (on("egress") | on("credential")), "exfil", SEVERITY["exfil"]),
    )
    found = F.filter(hits, lambda h: h.isNotNull())
    best = F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), lambda a, h: F.when(h["severity"] > a["severity"], h).otherwise(a))
    nothing = F.when(F.size("__commands") == 0, "unknown").otherwise("benign")
    out = parsed.withColumn("__best", best)
    return out.withColumn("category", F.coalesce(F.col("__best")["category"], nothing)).withColumn("severity", F.coalesce(F.col("__best")["severity"], F.lit(0.0))).drop("__commands", "__s", "__best")


def check_bands(bands: dict[str, float]) -> None:
    if not 1 >= bands["block"] > bands["review"] > bands["redact"] >= 0:
        raise ValueError("bands must fall strictly")


def action(category: Column, severity: Column, confidence: Column | None = None, bands: dict[str, float] | None = None) -> Column:
    """What evidence leads to: unknown and unsure go to review, the rest by bands of severity."""
    b = bands or BANDS
    check_bands(b)
    unsure = F.coalesce(confidence, F.lit(1.0)) < LEAST_CONFIDENCE if confidence is not None else F.lit(False)
    return F.when((category == "unknown") | unsure, "review").when(severity >= b["block"], "block").when(severity >= b["review"], "review").when(severity >= b["redact"], "redact").otherwise("allow")


def chain(*answers: Column) -> Column:
    """Of struct<category, ...> answers in order (null: the backend failed) the first that isn't unknown, else the last that came."""
    known = F.coalesce(*[F.when(a["category"] != "unknown", a) for a in answers])
    return F.coalesce(known, *reversed(answers))


def judge_report(cases: DataFrame, want: str = "want", got: str = "category") -> DataFrame:
    """Miss rate, false alarm rate and category accuracy over labelled actions; null without cases to divide by."""
    bad, flagged = F.col(want) != "benign", F.col(got) != "benign"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return cases.agg(
        F.count("*").alias("total"), n(bad).cast("long").alias("dangerous"), n(bad & ~flagged).cast("long").alias("missed"), n(~bad & flagged).cast("long").alias("false_alarms"),
        (n(bad & ~flagged) / F.nullif(n(bad), F.lit(0))).alias("miss_rate"), (n(~bad & flagged) / F.nullif(n(~bad), F.lit(0))).alias("false_alarm_rate"), (n(F.col(want) == F.col(got)) / F.nullif(F.count("*"), F.lit(0))).alias("category_accuracy"),
    )


def judge_by_category(cases: DataFrame, want: str = "want", got: str = "category") -> DataFrame:
    """Labelled actions by what they are: how many, how many were seen as that, and how many passed as benign."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return cases.groupBy(F.col(want).alias("want")).agg(F.count("*").alias("total"), n(F.col(want) == F.col(got)).alias("same"), n(F.col(got) == "benign").alias("as_benign"))
