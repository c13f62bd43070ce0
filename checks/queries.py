"""One query per operator, over the given tables or tables derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatprep import rules
from chatprep.functions.chat_template import render_template
from chatprep.functions.python_json import python_args_hash, python_json
from chatprep.functions.text import clean_text, preview, strip_reasoning, tokens_of
from chatprep.functions.tool_json import args_hash
from chatprep.operators import audit, calls, chat, pack, policy, search, split, usage
from chatprep.plans import corpus_search, training_set
from chatprep.session import new_path, written
from chatprep.sources import corpus as files
from chatprep.sources import pairs, tables
from chatprep.streaming import audit as streams
from chatprep.streaming import sessions, sinks
from checks import derived
from checks.derived import table

WRITE_TEXT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
ROOTS = ["/w"]
#: Text of one JSON list, which one task reads.
LIST_BYTES = 1 << 22


def _joined(name):
    return F.array_join(name, " & ").alias(name)


def _pair_columns(df):
    return df.select(F.col("pair_id").cast("long").alias("pair_id"), "instruction", "response", "input")


# Sources and sinks


def src_csv(spark, sf):
    path = new_path(spark, "pairs.csv")
    derived.raw_pairs(spark, sf).drop("conv_id").write.options(header=True, **WRITE_TEXT).csv(path)
    return _pair_columns(pairs.read_pairs(spark, path))


def src_json(spark, sf):
    path = new_path(spark, "pairs.json")
    rows = written(derived.raw_pairs(spark, sf), "pairs").select("pair_id", "instruction", "response", "input")
    # One list per file, as long as all others: rows are dealt by their place, whatever their keys.
    size = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in ("instruction", "response", "input")), F.lit(100))
    held = rows.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    n = max(1, -(-held // LIST_BYTES))
    dealt = rows.withColumn("part", F.monotonically_increasing_id() % n).repartition(n, "part")
    lists = dealt.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _pair_columns(pairs.read_pairs(spark, path))


def src_jsonl(spark, sf):
    path = new_path(spark, "pairs.jsonl")
    tables.write_jsonl(derived.raw_pairs(spark, sf), path)
    return _pair_columns(pairs.read_pairs(spark, path, input_col="input", keep=("pair_id",)))


def src_tsv(spark, sf):
    path = new_path(spark, "pairs.txt")
    rows = derived.raw_pairs(spark, sf).select("instruction", "response")
    rows.write.options(header=False, sep="\t", **WRITE_TEXT).csv(path)
    return pairs.read_pairs(spark, path)


def _formatted(spark, sf):
    kept = chat.valid_pairs(derived.raw_pairs(spark, sf))
    return chat.to_messages(kept, input_col="input")


def sink_jsonl_roundtrip(spark, sf):
    path = new_path(spark, "formatted.jsonl")
    tables.write_jsonl(_formatted(spark, sf), path)
    back = pairs.read_jsonl(spark, path, f"pair_id BIGINT, {tables.MESSAGES_SCHEMA}")
    return chat.explode_messages(back, ["pair_id"])


def sink_append_counts(spark, sf):
    path = new_path(spark, "pairs")
    rows = derived.raw_pairs(spark, sf)
    tables.write_table(rows, path)
    tables.write_table(chat.valid_pairs(rows), path, append=True)
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("n_rows"))


def land_raw_split(spark, sf):
    path = new_path(spark, "landed")
    tables.land_raw(split.split_hash(table(spark, sf, "conversations"), "conv_id", 0.5), path)
    return pairs.read_jsonl(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


def _split_formatted(spark, sf):
    return split.split_hash(_formatted(spark, sf), "conv_id", 0.8)


def splits_roundtrip(spark, sf):
    path = new_path(spark, "splits")
    tables.write_splits(_split_formatted(spark, sf), path)
    back = spark.read.schema(f"pair_id BIGINT, {tables.MESSAGES_SCHEMA}, split STRING").json(path)
    return chat.explode_messages(back, ["split", "pair_id"])


def read_splits(spark, sf):
    path = new_path(spark, "splits")
    tables.write_splits(_split_formatted(spark, sf), path)
    parts = {name: f"{path}/split={name}" for name in ("train", "validation")}
    back = tables.read_splits(spark, parts)
    return back.select("split", chat.render_chat(F.col("messages")).alias("text"))


def _split_file(spark, sf):
    raw, formatted, parts = (new_path(spark, name) for name in ("raw.jsonl", "formatted.jsonl", "parts"))
    tables.write_jsonl(derived.raw_pairs(spark, sf), raw)
    training_set.format_file(spark, raw, formatted, input_col="input")
    training_set.split_file(spark, formatted, parts, new_path(spark, "work"))
    named = {name: f"{parts}/split={name}" for name in ("train", "validation")}
    return training_set.text_of_splits(spark, named)


def split_file_texts(spark, sf):
    return _split_file(spark, sf).select("split", "text")


def split_file(spark, sf):
    return audit.split_counts(_split_file(spark, sf))


def jsonl_bad_lines(spark, sf):
    """Every third line of the pairs cut in two; what is read and what is set apart."""
    path = new_path(spark, "broken.jsonl")
    rows = derived.raw_pairs(spark, sf).select("pair_id", F.to_json(F.struct("pair_id", "instruction")).alias("line"))
    broken = F.when(F.col("pair_id") % 3 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    rows.select(broken).write.text(path)
    good, bad = pairs.read_jsonl_checked(spark, path, "pair_id BIGINT, instruction STRING")
    kept = good.select("pair_id", F.lit("good").alias("reason"))
    number = F.regexp_extract("line", r'"pair_id":(\d+)', 1).cast("long")
    return kept.unionByName(bad.select(number.alias("pair_id"), "reason"))


def corpus_truncate(spark, sf):
    texts, _ = files.limit_texts(derived.corpus(spark, sf), max_lines=20)
    return texts


def corpus_refused(spark, sf):
    _, refused = files.limit_texts(derived.corpus(spark, sf), max_bytes=10_000)
    return refused


def _corpus_folder(spark, sf):
    """All documents as files of their own, below folders that have their number, each with a line break at its end.

    Every file has one of five names, hidden ones among them; every tenth document has an
    empty file and an empty folder beside it.
    """
    path = new_path(spark, "files")
    rows = derived.corpus(spark, sf).select(F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).alias("doc"), "text")
    derived.write_files(rows.withColumn("text", F.concat("text", F.lit("\n"))), path)
    return path


def _doc(df):
    return df.withColumn("doc_id", F.regexp_extract("path", r"^doc=([0-9]+)/", 1).cast("long"))


def read_corpus_files(spark, sf):
    texts, _ = files.read_corpus(spark, _corpus_folder(spark, sf))
    return _doc(texts.where("length > 0")).select("doc_id", "length", "text", "truncated")


def read_corpus_names(spark, sf):
    """As they are read: paths, sizes and line counts, empty files among them."""
    texts, _ = files.read_corpus(spark, _corpus_folder(spark, sf))
    return texts.select("path", "length", "n_lines")


def list_corpus_files(spark, sf):
    listed = corpus_search.listing(spark, _corpus_folder(spark, sf), recursive=True)
    return _doc(listed.where("length > 0")).select("doc_id", "kind", "length")


def list_corpus_names(spark, sf):
    listed = corpus_search.listing(spark, _corpus_folder(spark, sf), recursive=True)
    return listed.select("path", "length", "entry")


def found_corpus_folders(spark, sf):
    """All folders, empty ones among them."""
    return corpus_search.found(spark, _corpus_folder(spark, sf), "**").where("kind = 'folder'").select("path", "entry")


def grep_corpus_files(spark, sf):
    found = corpus_search.search_folder(spark, _corpus_folder(spark, sf), r"\bthe\b", line_chars=rules.GREP_LINE_CHARS)
    return _doc(found).select("doc_id", F.col("line_num").cast("int").alias("line_num"), "line")


def _grep_ranges(spark, sf, size):
    """Whole lines with their numbers, of files that are cut into ranges of ``size`` bytes."""
    found = corpus_search.search_folder(spark, _corpus_folder(spark, sf), r"\bthe\b", range_bytes=size)
    return found.select("path", "line_num", "line")


def grep_corpus_ranges(spark, sf):
    return _grep_ranges(spark, sf, 1000)


def grep_corpus_tiny_ranges(spark, sf):
    return _grep_ranges(spark, sf, 7)


def list_files(spark, sf):
    return search.list_files(derived.corpus(spark, sf), recursive=True, pattern="*.py")


def list_dirs(spark, sf):
    return search.list_files(derived.corpus(spark, sf)).drop("length")


def search_files(spark, sf):
    return search.search_files(derived.corpus(spark, sf), "**/src1*/*.md")


def search_folders(spark, sf):
    return search.search_files(derived.corpus(spark, sf), "*/src[!0-8]").drop("length")


# Pairs, messages, training text


def q_clean_text(spark, sf):
    rows = derived.raw_pairs(spark, sf)
    return rows.select("pair_id", *[clean_text(F.col(c)).alias(c) for c in ("instruction", "response", "input")])


def valid_pairs(spark, sf):
    return chat.valid_pairs(derived.raw_pairs(spark, sf)).drop("conv_id")


def valid_pairs_compat(spark, sf):
    return chat.valid_pairs(derived.raw_pairs(spark, sf), compat=True).drop("conv_id")


def rejected_pairs(spark, sf):
    return chat.rejected_pairs(derived.raw_pairs(spark, sf)).select("pair_id", "reason")


def to_messages(spark, sf):
    return chat.explode_messages(_formatted(spark, sf), ["pair_id"])


def collect_messages(spark, sf):
    parts = chat.collect_messages(table(spark, sf, "conversations"), part_turns=3)
    return chat.explode_messages(parts, ["conv_id", "part"])


def _rendered(spark, sf, prompt):
    parts = chat.collect_messages(table(spark, sf, "conversations"))
    prompt = F.col("is_last") if prompt else False
    return parts.select("conv_id", "part", chat.render_chat(F.col("messages"), prompt).alias("text"))


def render_chat_parts(spark, sf):
    parts = chat.collect_messages(table(spark, sf, "conversations"), part_turns=3)
    return parts.select("conv_id", "part", chat.render_chat(F.col("messages"), F.col("is_last")).alias("text"))


#: Public layouts, as tokenizer files hold them.
TAGGED_TEMPLATE = """{% for message in messages %}
{% if message['role'] == 'user' %}
{{ '<|user|>\\n' + message['content'] + eos_token }}
{% elif message['role'] == 'system' %}
{{ '<|system|>\\n' + message['content'] + eos_token }}
{% elif message['role'] == 'assistant' %}
{{ '<|assistant|>\\n'  + message['content'] + eos_token }}
{% endif %}
{% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
{% endif %}
{% endfor %}"""
BRACKET_TEMPLATE = (
    "{% if messages[0]['role'] == 'system' %}{% set rest = messages[1:] %}{% set start = messages[0]['content'] %}"
    "{% else %}{% set rest = messages %}{% set start = false %}{% endif %}"
    "{% for message in rest %}{% if loop.index0 == 0 and start %}{% set content = '<<SYS>>\\n' + start + '\\n<</SYS>>\\n\\n' "
    "+ message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}"
    "{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content | trim + ' [/INST]' }}"
    "{% elif message['role'] == 'assistant' %}{{ ' ' + content | trim + ' ' + eos_token }}{% endif %}{% endfor %}"
)


def _templated(spark, sf, template, **how):
    whole = chat.collect_messages(table(spark, sf, "conversations"))
    prompt = F.col("is_last") & (F.col("conv_id") % 2 == 0)
    text = render_template(F.col("messages"), template, prompt, **how)
    return whole.select("conv_id", "part", text.alias("text"))


def render_template_tagged(spark, sf):
    return _templated(spark, sf, TAGGED_TEMPLATE, eos_token="</s>")


def render_template_brackets(spark, sf):
    return _templated(spark, sf, BRACKET_TEMPLATE, bos_token="<s>", eos_token="</s>")


def set_size(spark, sf):
    turns = table(spark, sf, "conversations")
    parts = chat.to_training_text(chat.collect_messages(turns, part_turns=3))
    return training_set.set_size(pack.count_tokens(split.split_hash(parts, "conv_id")))


def render_chat(spark, sf):
    return _rendered(spark, sf, False)


def render_chat_prompt(spark, sf):
    return _rendered(spark, sf, True)


def training_text(spark, sf):
    return chat.to_training_text(_formatted(spark, sf)).select("pair_id", "text")


def _answers(spark, sf):
    return derived.responses(spark, sf).withColumn("text", strip_reasoning(F.col("text")))


def q_strip_reasoning(spark, sf):
    return _answers(spark, sf).drop("role")


def tool_calls(spark, sf):
    return calls.extract_tool_calls(_answers(spark, sf))


def tool_calls_balanced(spark, sf):
    return calls.extract_tool_calls(_answers(spark, sf), "balanced")


def tool_calls_failed(spark, sf):
    return calls.failed_tool_calls(_answers(spark, sf))


def call_fields(spark, sf):
    found = calls.extract_tool_calls(_answers(spark, sf))
    return found.groupBy("tool", "arguments").agg(F.count("*").alias("n_calls"))


def q_preview(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        preview(text, rules.ARGUMENT_PREVIEW_CHARS, True).alias("arguments"),
        preview(text, rules.RESULT_PREVIEW_CHARS, True).alias("result"),
        preview(text, rules.AUDIT_PREVIEW_CHARS).alias("audit"),
        preview(text, rules.GREP_LINE_CHARS).alias("line"),
    )


def q_args_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", args_hash(F.col("props")).alias("args_hash"))


def args_hash_compat(spark, sf):
    """The bytes that Python writes, and the hash over them."""
    rows = derived.python_arguments(spark, sf)
    arguments = F.col("arguments")
    return rows.select(
        "event_id", python_json(arguments).alias("written"), python_args_hash(arguments).alias("args_hash")
    )


def tool_messages(spark, sf):
    rows = derived.unnumbered_calls(table(spark, sf, "events"))
    return rows.select("event_id", chat.tool_message(F.col("tool"), F.col("result")).alias("content"))


# Search


def grep_docs(spark, sf):
    return search.grep(derived.corpus(spark, sf), r"\bthe\b")


def grep_docs_case(spark, sf):
    return search.grep(derived.corpus(spark, sf), "The", case_sensitive=True)


def grep_docs_include(spark, sf):
    return search.grep(derived.corpus(spark, sf), "[aeiou]{3}", include="*[13].py")


def grep_top50(spark, sf):
    return search.grep_report(derived.corpus(spark, sf), r"\bthe\b")


def grep_counts(spark, sf):
    rows = derived.corpus(spark, sf)
    return search.grep_summary(rows, search.grep(rows, r"\bthe\b"))


def grep_by_file(spark, sf):
    return search.grep_by_file(search.grep(derived.corpus(spark, sf), r"\bthe\b"))


def cap_with_rest(spark, sf):
    listed = search.list_files(derived.corpus(spark, sf), recursive=True, pattern="*.md")
    return search.cap_with_rest(listed.select("path", "length"), ["path"])


# Calls and the catalogue


def _calls(spark, sf):
    return derived.unnumbered_calls(table(spark, sf, "events"))


def resolved_calls(spark, sf):
    rows = calls.resolve_calls(_calls(spark, sf), calls.tool_catalogue(spark))
    return rows.select("event_id", "tool", "known", "message")


def unknown_calls(spark, sf):
    return calls.unknown_calls(_calls(spark, sf), calls.tool_catalogue(spark)).select("event_id", "tool")


def hidden_tool_calls(spark, sf):
    shown = calls.tool_catalogue(spark, safe_mode=True)
    return calls.unsafe_calls(_calls(spark, sf), calls.tool_catalogue(spark), shown).select("event_id", "tool")


def argument_check(spark, sf):
    rows = calls.check_arguments(_calls(spark, sf), calls.tool_catalogue(spark))
    return rows.select("event_id", "is_object", _joined("missing"), _joined("unexpected"), "valid")


def effective_arguments(spark, sf):
    rows = calls.effective_arguments(_calls(spark, sf), calls.tool_catalogue(spark))
    return rows.select("event_id", "argument", "value", "is_default")


def effective_timeout(spark, sf):
    rows = calls.effective_timeout(_calls(spark, sf), calls.tool_catalogue(spark))
    return rows.select("event_id", "tool", "timeout", "is_default")


# Policy


def _argument(name):
    return F.get_json_object("arguments", f"$.{name}").alias(name)


def screen_paths(spark, sf):
    rows = _calls(spark, sf).select("event_id", _argument("path")).where("path is not null")
    return policy.screen_paths(rows, ROOTS).withColumn("matched", _joined("matched"))


def screen_paths_links(spark, sf):
    rows = _calls(spark, sf).select("event_id", _argument("path")).where("path is not null")
    found = policy.screen_paths(rows, ROOTS, links=derived.links(spark, sf))
    return found.withColumn("matched", _joined("matched"))


def screen_commands(spark, sf):
    rows = _calls(spark, sf).select("event_id", _argument("command")).where("command is not null")
    return policy.screen_commands(rows).withColumn("matched", _joined("matched"))


def screen_code(spark, sf):
    rows = _calls(spark, sf).select("event_id", _argument("code")).where("code is not null")
    return policy.screen_code(rows).withColumn("matched", _joined("matched"))


def screen_calls(spark, sf):
    rows = streams.policy_stream(_calls(spark, sf), ROOTS)
    return rows.select("event_id", "tool", "verdict", "rule", "reason", "argument")


def policy_summary(spark, sf):
    return policy.policy_summary(policy.screen_calls(_calls(spark, sf), ROOTS))


# Usage and outcomes


def _usage(spark, sf):
    return usage.context_usage(table(spark, sf, "conversations"), part_turns=3)


def context_usage(spark, sf):
    return _usage(spark, sf)


def limit_breach(spark, sf):
    return usage.limit_breach(_usage(spark, sf), max_total=2000)


def context_status(spark, sf):
    return usage.context_status(_usage(spark, sf), limit=2000)


def context_status_counts(spark, sf):
    rows = usage.context_status(_usage(spark, sf), limit=2000)
    return rows.groupBy("status", "warning").agg(F.count("*").alias("n_answers"))


def _with_call_counts(answers):
    return answers.select("conv_id", "turn", calls.count_calls(F.col("text")).alias("n_calls"))


def session_outcome(spark, sf):
    return usage.session_outcome(_with_call_counts(_answers(spark, sf)))


def session_outcome_limited(spark, sf):
    answers = _answers(spark, sf)
    breaches = usage.limit_breach(usage.context_usage(answers), max_total=1100)
    return usage.session_outcome(_with_call_counts(answers), breaches=breaches)


def calls_over_cap(spark, sf):
    return usage.calls_over_cap(_calls(spark, sf))


def failure_streaks(spark, sf):
    return usage.failure_streaks(derived.calls(spark, sf))


# Audit


def _audit(spark, sf):
    return audit.audit_log(derived.calls(spark, sf))


def audit_log(spark, sf):
    return _audit(spark, sf).withColumn("ts", audit.iso_timestamp(F.col("ts"))).withColumnRenamed("ts", "timestamp")


def audit_append(spark, sf):
    path = new_path(spark, "audit")
    log = _audit(spark, sf)
    for success in (True, False):
        audit.append_audit_log(log.where(F.col("success") == success), path)
    kept = spark.read.parquet(path).groupBy("day", "success").agg(F.count("*").alias("n_calls"))
    return kept.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def stage_counts(spark, sf):
    rows = split.split_hash(derived.raw_pairs(spark, sf), "conv_id", 0.8)
    return audit.stage_counts(rows, chat.reject_reason().isNull(), F.col("split"))


def session_metrics(spark, sf):
    log = audit.audit_log(derived.calls(spark, sf))
    return audit.session_metrics(log, usage.context_usage(_answers(spark, sf)))


def tool_metrics(spark, sf):
    return audit.tool_metrics(_audit(spark, sf))


def error_history(spark, sf):
    return audit.error_history(_audit(spark, sf)).withColumn("ts", audit.iso_timestamp(F.col("ts")))


# Splits and packing


def split_exact(spark, sf):
    return split.split_exact(table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


def split_counts(spark, sf):
    return audit.split_counts(split.split_exact(table(spark, sf, "documents"), "doc_id"))


def split_hash(spark, sf):
    turns = table(spark, sf, "conversations")
    return split.split_hash(turns, "conv_id").select("conv_id", "turn", "split")


def token_counts(spark, sf):
    return pack.count_tokens(table(spark, sf, "documents")).select("doc_id", "n_tokens")


def _pieces(spark, sf):
    return pack.pack_sequences(token_counts(spark, sf), "doc_id", max_len=512, shards=16)


def pack_blocks(spark, sf):
    return _pieces(spark, sf)


def pack_one_stream(spark, sf):
    return pack.pack_sequences(token_counts(spark, sf), "doc_id", max_len=512)


def pack_fill(spark, sf):
    return pack.pack_fill(_pieces(spark, sf), 512)


def fill_blocks(spark, sf):
    samples = table(spark, sf, "documents").select("doc_id", tokens_of(F.col("text")).alias("tokens"))
    blocks = pack.pack_tokens(samples, "doc_id", 512, 16)
    return blocks.select("shard", "block", F.array_join("tokens", " ").alias("text"))


def _whole(spark, sf):
    return pack.pack_whole(token_counts(spark, sf), "doc_id", max_len=512)


def pack_whole(spark, sf):
    """Where each document goes; those without a place have -1."""
    none = F.lit(-1).cast("long")
    return _whole(spark, sf).withColumns({name: F.coalesce(name, none) for name in ("block", "block_from")})


def pack_whole_fill(spark, sf):
    return pack.whole_fill(_whole(spark, sf), 512)


def whole_tokens(spark, sf):
    samples = table(spark, sf, "documents").select("doc_id", tokens_of(F.col("text")).alias("tokens"))
    blocks = pack.whole_tokens(samples, "doc_id", 512)
    return blocks.select("block", F.array_join("tokens", " ").alias("text"), F.array_join("ends", " ").alias("ends"))


def length_report(spark, sf):
    return pack.length_report(token_counts(spark, sf), 512)


# Streams


def _window_text(df):
    return df.withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("window_start", "window_end")}
    )


def audit_windows(spark, sf):
    return _window_text(streams.audit_stream_metrics(_calls(spark, sf)))


def _arriving_calls(spark, sf):
    schema = table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return derived.unnumbered_calls(arriving)


def audit_stream(spark, sf):
    out = new_path(spark, "windows")
    streams.write_stream(
        streams.audit_stream_metrics(_arriving_calls(spark, sf)), out, new_path(spark, "progress")
    ).awaitTermination()
    return _window_text(spark.read.parquet(out))


def policy_stream(spark, sf):
    out = new_path(spark, "screened")
    streams.write_policy_stream(
        streams.policy_stream(_arriving_calls(spark, sf), ROOTS), out, new_path(spark, "progress")
    ).awaitTermination()
    return spark.read.parquet(out).select("event_id", "tool", "rule", "verdict")


def policy_sinks(spark, sf):
    """Every screened call, and the refused ones again in a sink of their own, each once."""
    out = new_path(spark, "sinks")
    screened = streams.policy_stream(_arriving_calls(spark, sf), ROOTS).select("event_id", "verdict")
    chosen = {"every": F.lit(True), "refused": F.col("verdict") == "refused"}
    # The second start finds nothing new and writes nothing.
    progress = new_path(spark, "progress")
    for _ in range(2):
        sinks.write_sinks(screened, chosen, out, progress).awaitTermination()
    both = [sinks.read_sink(spark, f"{out}/{name}", "event_id BIGINT, verdict STRING").withColumn("sink", F.lit(name)) for name in chosen]
    return both[0].unionByName(both[1]).select("sink", "event_id", "verdict")


def _live(spark, sf):
    source, out = new_path(spark, "calls"), new_path(spark, "live")
    tokens = F.length("result").cast("long").alias("tokens")
    rows = derived.calls(spark, sf).select("session_id", "call_no", F.col("ts").cast("timestamp").alias("ts"), "success", tokens)
    rows.write.parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sessions.STATE_STORE)
    try:
        live = sessions.live_sessions(spark.readStream.schema(rows.schema).parquet(source))
        streams.write_stream(live, out, new_path(spark, "progress")).awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(sessions.EVENT).parquet(out)


def live_streaks(spark, sf):
    """Streaks that a success has ended, as calls arrive."""
    return _live(spark, sf).where("kind = 'streak'").select("session_id", "first_call", "last_call", "length")


def live_metrics(spark, sf):
    """The last figures of each session as its calls arrive."""
    found = _live(spark, sf).where("kind = 'metrics'")
    last = F.max_by(F.struct("n_calls", "n_errors", "total_tokens", "elapsed_us"), "n_calls").alias("last")
    return found.groupBy("session_id").agg(last).select("session_id", "last.*")


QUERIES = {
    "src_csv": src_csv,
    "src_json": src_json,
    "src_jsonl": src_jsonl,
    "src_tsv": src_tsv,
    "sink_jsonl_roundtrip": sink_jsonl_roundtrip,
    "sink_append_counts": sink_append_counts,
    "land_raw_split": land_raw_split,
    "read_splits": read_splits,
    "splits_roundtrip": splits_roundtrip,
    "split_file": split_file,
    "split_file_texts": split_file_texts,
    "jsonl_bad_lines": jsonl_bad_lines,
    "render_chat_parts": render_chat_parts,
    "set_size": set_size,
    "corpus_truncate": corpus_truncate,
    "corpus_refused": corpus_refused,
    "read_corpus_files": read_corpus_files,
    "list_corpus_files": list_corpus_files,
    "read_corpus_names": read_corpus_names,
    "list_corpus_names": list_corpus_names,
    "found_corpus_folders": found_corpus_folders,
    "grep_corpus_files": grep_corpus_files,
    "grep_corpus_ranges": grep_corpus_ranges,
    "grep_corpus_tiny_ranges": grep_corpus_tiny_ranges,
    "list_files": list_files,
    "list_dirs": list_dirs,
    "search_files": search_files,
    "search_folders": search_folders,
    "clean_text": q_clean_text,
    "valid_pairs": valid_pairs,
    "valid_pairs_compat": valid_pairs_compat,
    "rejected_pairs": rejected_pairs,
    "to_messages": to_messages,
    "collect_messages": collect_messages,
    "render_chat": render_chat,
    "render_chat_prompt": render_chat_prompt,
    "render_template_tagged": render_template_tagged,
    "render_template_brackets": render_template_brackets,
    "training_text": training_text,
    "strip_reasoning": q_strip_reasoning,
    "tool_calls": tool_calls,
    "tool_calls_balanced": tool_calls_balanced,
    "tool_calls_failed": tool_calls_failed,
    "call_fields": call_fields,
    "preview": q_preview,
    "args_hash": q_args_hash,
    "args_hash_compat": args_hash_compat,
    "tool_messages": tool_messages,
    "grep_docs": grep_docs,
    "grep_docs_case": grep_docs_case,
    "grep_docs_include": grep_docs_include,
    "grep_top50": grep_top50,
    "grep_counts": grep_counts,
    "grep_by_file": grep_by_file,
    "cap_with_rest": cap_with_rest,
    "resolved_calls": resolved_calls,
    "unknown_calls": unknown_calls,
    "hidden_tool_calls": hidden_tool_calls,
    "argument_check": argument_check,
    "effective_arguments": effective_arguments,
    "effective_timeout": effective_timeout,
    "screen_paths": screen_paths,
    "screen_paths_links": screen_paths_links,
    "screen_commands": screen_commands,
    "screen_code": screen_code,
    "screen_calls": screen_calls,
    "policy_summary": policy_summary,
    "context_usage": context_usage,
    "limit_breach": limit_breach,
    "context_status": context_status,
    "context_status_counts": context_status_counts,
    "session_outcome": session_outcome,
    "session_outcome_limited": session_outcome_limited,
    "calls_over_cap": calls_over_cap,
    "failure_streaks": failure_streaks,
    "audit_log": audit_log,
    "audit_append": audit_append,
    "stage_counts": stage_counts,
    "session_metrics": session_metrics,
    "tool_metrics": tool_metrics,
    "error_history": error_history,
    "split_exact": split_exact,
    "split_counts": split_counts,
    "split_hash": split_hash,
    "token_counts": token_counts,
    "pack_blocks": pack_blocks,
    "pack_one_stream": pack_one_stream,
    "pack_fill": pack_fill,
    "fill_blocks": fill_blocks,
    "pack_whole": pack_whole,
    "pack_whole_fill": pack_whole_fill,
    "whole_tokens": whole_tokens,
    "length_report": length_report,
    "audit_windows": audit_windows,
    "audit_stream": audit_stream,
    "policy_stream": policy_stream,
    "policy_sinks": policy_sinks,
    "live_streaks": live_streaks,
    "live_metrics": live_metrics,
}
