"""Chat templates: conversations rendered to prompts, and message lists for services.

A style is data: how the system text opens a prompt, how a turn and an open turn (null or empty
text) are written, and how the prompt ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Values of one chat template."""

    name: str
    style: str
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    system_template: str = "{system_message}"
    system_message: str = ""
    sep: str = "\n"
    sep2: str | None = None
    stop_str: str | None = None


@dataclass(frozen=True)
class Turn:
    """Columns of one turn: role label, text, and position in the conversation."""

    role: Column
    text: Column
    i: Column

    def alternate(self, even, odd) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(self.i % 2 == 0, lit(even)).otherwise(lit(odd))


@dataclass(frozen=True)
class Style:
    """``head(template, system)``, ``said`` and ``open`` of a turn, and an optional ``finish``."""

    head: Callable[[Template, Column], Column]
    said: Callable[[Template, Turn], list]
    open: Callable[[Template, Turn], list]
    finish: Callable[[Template, Column], Column] = lambda t, c: c
    last: int | None = None  # only so many of the latest turns


def _plain(t: Template, system: Column) -> Column:
    return system


def _then_sep(t: Template, system: Column) -> Column:
    return F.concat(system, F.lit(t.sep))


def _sep_if(end: str = "") -> Callable:
    return lambda t, system: F.when(system == "", F.lit("")).otherwise(F.concat(system, F.lit(t.sep + end)))


def _two(t: Template, turn: Turn) -> Column:
    return turn.alternate(t.sep, t.sep2 or "")


def _round_no(t: Template, turn: Turn) -> Column:
    first = 1 if t.name == "chatglm2" else 0
    return turn.alternate(F.concat(F.lit("[Round "), (F.floor(turn.i / 2) + first).cast("string"), F.lit("]" + t.sep)), "")


#: What each separator style writes.
STYLES: dict[str, Style] = {
    "ADD_COLON_SINGLE": Style(_then_sep, lambda t, m: [m.role, ": ", m.text, t.sep], lambda t, m: [m.role, ":"]),
    "ADD_COLON_TWO": Style(_then_sep, lambda t, m: [m.role, ": ", m.text, _two(t, m)], lambda t, m: [m.role, ":"]),
    "ADD_COLON_SPACE_SINGLE": Style(_then_sep, lambda t, m: [m.role, ": ", m.text, t.sep], lambda t, m: [m.role, ": "]),
    "ADD_NEW_LINE_SINGLE": Style(_sep_if(), lambda t, m: [m.role, "\n", m.text, t.sep], lambda t, m: [m.role, "\n"]),
    "NO_COLON_SINGLE": Style(_plain, lambda t, m: [m.role, m.text, t.sep], lambda t, m: [m.role]),
    "NO_COLON_TWO": Style(_plain, lambda t, m: [m.role, m.text, _two(t, m)], lambda t, m: [m.role]),
    "RWKV": Style(_plain, lambda t, m: [m.role, ": ", F.replace(F.replace(m.text, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")), "\n\n"], lambda t, m: [m.role, ":"]),
    "LLAMA2": Style(
        lambda t, s: F.when(s == "", F.lit("[INST] ")).otherwise(s),
        lambda t, m: [F.when(m.i == 0, F.concat(m.text, F.lit(" "))).otherwise(F.concat(m.alternate(*t.roles), F.lit(" "), m.text, _two(t, m)))],
        lambda t, m: [m.alternate(*t.roles)],
    ),
    "LLAMA3": Style(
        lambda t, s: F.concat(F.lit("<|begin_of_text|>"), s),
        lambda t, m: ["<|start_header_id|>", m.role, "<|end_header_id|>\n\n", F.regexp_replace(m.text, "^\\s+|\\s+$", ""), "<|eot_id|>"],
        lambda t, m: ["<|start_header_id|>", m.role, "<|end_header_id|>\n\n"],
    ),
    "CHATGLM": Style(_sep_if(), lambda t, m: [_round_no(t, m), m.role, "：", m.text, t.sep], lambda t, m: [_round_no(t, m), m.role, "："]),
    "CHATML": Style(_sep_if("\n"), lambda t, m: [m.role, "\n", m.text, t.sep, "\n"], lambda t, m: [m.role, "\n"]),
    "CHATGLM3": Style(_plain, lambda t, m: [m.role, "\n", m.text], lambda t, m: [m.role]),
    "CHATINTERN": Style(_plain, lambda t, m: [m.alternate("<s>", ""), m.role, ":", m.text, _two(t, m), "\n"], lambda t, m: [m.alternate("<s>", ""), m.role, ":"]),
    "DOLLY": Style(_plain, lambda t, m: [m.role, ":\n", m.text, _two(t, m), m.alternate("", "\n\n")], lambda t, m: [m.role, ":\n"]),
    "PHOENIX": Style(_plain, lambda t, m: [m.role, ": <s>", m.text, "</s>"], lambda t, m: [m.role, ": <s>"]),
    "ROBIN": Style(_then_sep, lambda t, m: [m.role, ":\n", m.text, t.sep], lambda t, m: [m.role, ":\n"]),
    "FALCON_CHAT": Style(_sep_if(), lambda t, m: [m.role, ": ", m.text, t.sep], lambda t, m: [m.role, ":"]),
    "METAMATH": Style(_sep_if(), lambda t, m: [m.role, m.alternate(":\n", ": " + (t.sep2 or "")), m.text, m.alternate(t.sep, "")], lambda t, m: [m.role, m.alternate(":\n", ": " + (t.sep2 or ""))]),
    "DEEPSEEK_CHAT": Style(_plain, lambda t, m: [m.role, ": ", m.text, _two(t, m)], lambda t, m: [m.role, ":"]),
    "YUAN2": Style(
        lambda t, s: F.when(s == "", F.lit("")).otherwise(F.concat(s, F.lit(t.sep2 or ""))), lambda t, m: [m.text, "<n>"], lambda t, m: [""],
        finish=lambda t, c: F.concat(F.regexp_replace(c, "[<n>]+$", ""), F.lit(t.sep)),
    ),
    "GEMMA": Style(lambda t, s: F.lit("<bos>"), lambda t, m: ["<start_of_turn>", m.role, "\n", m.text, t.sep], lambda t, m: ["<start_of_turn>", m.role, "\n"]),
    "CLLM": Style(_then_sep, lambda t, m: [m.role, ": ", m.text, _two(t, m)], lambda t, m: [m.role, ":"], last=2),
    "DEFAULT": Style(lambda t, s: F.concat(s, F.lit("\n")), lambda t, m: [m.role, ": ", m.text, "\n"], lambda t, m: [m.role, ":"]),
}

_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_TASK = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
_IM, _IM_ROLES = "<|im_start|>system\n{system_message}", ("<|im_start|>user", "<|im_start|>assistant")
_SYS, _INST = "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n", ("[INST]", "[/INST]")
_PIPES = ("<|user|>", "<|assistant|>")
_LOWER, _TITLE, _TASK_ROLES = ("user", "assistant"), ("Human", "Assistant"), ("### Instruction", "### Response")

# Public chat formats by style, as (name, roles, sep, sep2, system message, system
# template).  Vendors' long system texts are left to the conversations' own system turns.
_FORMATS: dict[str, list[tuple]] = {
    "CHATML": [
        ("chatml", _IM_ROLES, "<|im_end|>", None, "", _IM),
        ("mpt-7b-chat", _IM_ROLES, "<|im_end|>", None, "", _IM),
        ("mpt-30b-chat", _IM_ROLES, "<|im_end|>", None, "A conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers.", _IM),
        ("lemur-70b-chat", _IM_ROLES, "<|im_end|>", None, "You are a helpful, respectful, and honest assistant.", _IM),
        ("starchat", _PIPES, "<|end|>", None, "", "<system>\n{system_message}"),
        ("mistral-7b-openorca", _IM_ROLES, "<|im_end|>", None, "You are MistralOrca, a large language model trained by Alignment Lab AI. Write out your reasoning step-by-step to be sure you get the right answers!", _IM),
        ("dolphin-2.2.1-mistral-7b", _IM_ROLES, "<|im_end|>", None, "You are Dolphin, a helpful AI assistant.", _IM),
        ("OpenHermes-2.5-Mistral-7B", _IM_ROLES, "<|im_end|>", None, "", _IM),
        ("Nous-Hermes-2-Mixtral-8x7B-DPO", _IM_ROLES, "<|im_end|>", None, "", _IM),
        ("qwen-7b-chat", _IM_ROLES, "<|im_end|>", None, "You are a helpful assistant.", _IM),
        ("Yi-34b-chat", _IM_ROLES, "<|im_end|>"),
        ("zephyr", _PIPES, "</s>", None, "", "<|system|>\n{system_message}"),
        ("catppt", _PIPES, "</s>", None, "", "<|system|>\n{system_message}"),
        ("TinyLlama", _PIPES, "</s>", None, "", "<|system|>\n{system_message}"),
        ("orca-2", _IM_ROLES, "<|im_end|>", None, "", _IM),
        ("llava-chatml", _IM_ROLES, "<|im_end|>", None, "Answer the questions.", _IM),
    ],
    "NO_COLON_SINGLE": [
        ("raw", ("", ""), ""),
        ("codegeex", ("", ""), "\n\n"),
        ("oasst_pythia", ("<|prompter|>", "<|assistant|>"), "<|endoftext|>"),
        ("oasst_llama", ("<|prompter|>", "<|assistant|>"), "</s>"),
        ("stablelm", ("<|USER|>", "<|ASSISTANT|>"), "", None, "", "<|SYSTEM|>{system_message}"),
        ("baize", ("[|Human|]", "[|AI|]"), "\n"),
        ("h2ogpt", ("<|prompt|>", "<|answer|>"), "</s>"),
        ("baichuan-chat", ("<reserved_102>", "<reserved_103>"), ""),
        ("baichuan2-chat", ("<reserved_106>", "<reserved_107>"), ""),
        ("metharme", ("<|user|>", "<|model|>"), "", None, "", "<|system|>{system_message}"),
        ("xdan-v1", ("### Human", "### Assistant"), "\n", None, "You are a helpful  and harmless assistant named xDAN and created by xDAN-AI.Please response and work on questions thinking step by step."),
        ("yuan", ("", ""), "<sep>", None, "", ""),
    ],
    "DEFAULT": [
        ("api_based_default", _LOWER, ""),
        ("chatgpt", _LOWER, "", None, "You are a helpful assistant."),
        ("gpt-4-turbo-2024-04-09", _LOWER, ""),
        ("pplxai", _LOWER, "", None, "Be precise and concise."),
        ("claude-3-haiku-20240307", _LOWER, ""),
        ("claude-3-sonnet-20240229", _LOWER, ""),
        ("claude-3-5-sonnet-20240620", _LOWER, ""),
        ("claude-3-opus-20240229", _LOWER, ""),
        ("bard", ("0", "1"), ""),
        ("gemini", ("user", "model"), ""),
        ("gemini-1.5-pro", ("user", "model"), ""),
        ("steerlm", _LOWER, ""),
    ],
    "ADD_COLON_SINGLE": [
        ("one_shot", _TITLE, "\n### ", None, _HUMAN),
        ("zero_shot", _TITLE, "\n### ", None, _HUMAN),
        ("openbuddy", ("User", "Assistant"), "\n"),
        ("claude", _TITLE, "\n\n"),
        ("redpajama-incite", ("<human>", "<bot>"), "\n"),
        ("snoozy", ("### Prompt", "### Response"), "\n", None, "The prompt below is a question to answer, a task to complete, or a conversation to respond to; decide which and write an appropriate response.", "### Instruction:\n{system_message}"),
        ("polyglot_changgpt", ("B", "A"), "\n"),
        ("xgen", ("### Human", "### Assistant"), "\n", None, _HUMAN + "\n\n"),
        ("aquila-chat", _TITLE, "###", "", _HUMAN),
        ("phind", ("### User Message", "### Assistant"), "\n\n", None, "### System Prompt\nYou are an intelligent programming assistant."),
    ],
    "ADD_COLON_TWO": [
        ("vicuna_v1.1", ("USER", "ASSISTANT"), " ", "</s>", _USER),
        ("airoboros_v1", ("USER", "ASSISTANT"), " ", "</s>"),
        ("airoboros_v2", ("USER", "ASSISTANT"), "\n", "</s>", "A chat."),
        ("koala_v1", ("USER", "GPT"), " ", "</s>", "BEGINNING OF CONVERSATION:"),
        ("alpaca", _TASK_ROLES, "\n\n", "</s>", _TASK),
        ("manticore", ("USER", "ASSISTANT"), "\n", "</s>"),
        ("aquila", _TITLE, "###", "</s>", _HUMAN),
        ("llama2-chinese", _TITLE, "\n", "\n</s><s>", "", "<s>{system_message}</s>"),
        ("vigogne_chat_v2", _PIPES, "\n", "</s>\n", "", "<|system|>: {system_message}"),
        ("stable-vicuna", ("### Human", "### Assistant"), "\n", "\n\n", "### Assistant: I am StableVicuna, a large language model created by CarperAI. I am here to chat!\n"),
    ],
    "LLAMA2": [
        ("airoboros_v3", _INST, " ", " </s><s>", "You are a helpful, unbiased, uncensored assistant.", _SYS),
        ("mistral", _INST, " ", "</s>", "", "[INST] {system_message}\n"),
        ("llama-2", _INST, " ", " </s><s>", "", _SYS),
        ("chinese-alpaca2", _INST, " ", " </s><s>", "You are a helpful assistant. 你是一个乐于助人的助手。请你提供专业、有逻辑、内容真实、有价值的详细回复。", _SYS),
        ("vigogne_chat_v3", _INST, " ", " </s>", "", _SYS),
    ],
    "ADD_NEW_LINE_SINGLE": [
        ("deepseek-coder", ("### Instruction:", "### Response:"), "\n"),
        ("tulu", _PIPES, "\n"),
        ("mpt-30b-instruct", _TASK_ROLES, "\n\n", None, _TASK),
        ("solar", ("### User", "### Assistant"), "\n\n"),
    ],
    "FALCON_CHAT": [
        ("openchat_3.5", ("GPT4 Correct User", "GPT4 Correct Assistant"), "<|end_of_turn|>"),
        ("tenyxchat", ("User", "Assistant"), "<|end_of_turn|>"),
        ("falcon-chat", ("User", "Falcon"), "\n", "<|endoftext|>", "", "System: {system_message}"),
    ],
    "NO_COLON_TWO": [
        ("cutegpt", ("问：", "答：\n"), "\n", "\n"),
        ("aquila-legacy", ("### Human: ", "### Assistant: "), "\n", "</s>", _HUMAN + "\n\n"),
        ("aquila-v1", ("<|startofpiece|>", "<|endofpiece|>"), "", "</s>"),
    ],
    "CHATGLM": [("chatglm", ("问", "答"), "\n"), ("chatglm2", ("问", "答"), "\n\n")],
    "DOLLY": [("dolly_v2", _TASK_ROLES, "\n\n", "### End", _TASK + "\n\n"), ("vigogne_instruct", _TASK_ROLES, "\n\n", "</s>", "", "### System:\n{system_message}\n\n")],
    "RWKV": [("rwkv", ("Bob", "Alice"), ""), ("falcon", ("User", "Assistant"), "\n", "<|endoftext|>")],
    "PHOENIX": [("phoenix", _TITLE, "</s>", None, _HUMAN + "\n\n"), ("ReaLM-7b-v1", _TITLE, "</s>", None, _HUMAN + "\n\n")],
    "ADD_COLON_SPACE_SINGLE": [("billa", _TITLE, "\n"), ("open-orca", ("User", "Assistant"), "<|end_of_turn|>\n")],
    "ROBIN": [("Robin", ("###Human", "###Assistant"), "\n", None, _HUMAN), ("tigerbot", _TASK_ROLES, "\n\n", None, _USER)],
    "CHATGLM3": [("chatglm3", _PIPES, "", None, "", "<|system|>\n{system_message}")],
    "METAMATH": [("metamath", _TASK_ROLES, "\n\n", "Let's think step by step.", _TASK)],
    "CHATINTERN": [("internlm-chat", ("<|User|>", "<|Bot|>"), "<eoh>", "<eoa>", "A chat between a curious <|User|> and an <|Bot|>. The <|Bot|> gives helpful, detailed, and polite answers to the <|User|>'s questions.\n\n")],
    "LLAMA3": [("llama-3", _LOWER, "", None, "", "<|start_header_id|>system<|end_header_id|>\n\n{system_message}<|eot_id|>")],
    "DEEPSEEK_CHAT": [("deepseek-chat", ("User", "Assistant"), "\n\n", "<｜end▁of▁sentence｜>", "<｜begin▁of▁sentence｜>")],
    "YUAN2": [("yuan2", _LOWER, "<sep>", "\n")],
    "CLLM": [("cllm", ("USER", "ASSISTANT"), " ", "</s>", _USER)],
    "GEMMA": [("gemma", ("user", "model"), "<end_of_turn>\n")],
}
# Where generation stops, for the formats that name a stop text.
_STOPS = {
    "one_shot": "###", "zero_shot": "###", "deepseek-coder": "<|EOT|>", "baize": "[|Human|]", "rwkv": "\n\n", "billa": "Human:", "redpajama-incite": "<human>", "Robin": "###", "snoozy": "###",
    "falcon": "\nUser", "tigerbot": "###", "internlm-chat": "<|User|>", "starchat": "<|end|>", "llama-3": "<|eot_id|>", "cutegpt": "<end>", "open-orca": "User", "qwen-7b-chat": "<|endoftext|>",
    "Yi-34b-chat": "<|endoftext|>", "llama2-chinese": "</s>", "vigogne_chat_v2": "<|user|>", "falcon-chat": "\nUser:", "metharme": "<|user|>", "xdan-v1": "</s>", "zephyr": "</s>", "catppt": "</s>",
    "TinyLlama": "</s>", "orca-2": "<|im_end|>", "deepseek-chat": "<｜end▁of▁sentence｜>", "yuan2": "<eod>", "solar": "</s>", "yuan": "<eod>", "llava-chatml": "<|im_end|>", "gemma": "<end_of_turn>",
}
TEMPLATES: dict[str, Template] = {}


def register(template: Template, override: bool = False) -> None:
    """Add a template under its name; a name is registered once unless ``override``."""
    if template.style not in STYLES:
        raise ValueError(f"no style {template.style!r}")
    if template.name in TEMPLATES and not override:
        raise ValueError(f"{template.name} is registered already")
    TEMPLATES[template.name] = template


for _style, _rows in _FORMATS.items():
    for _name, _roles, _sep, *_more in _rows:
        _sep2, _message, _template = [*_more, *(None, "", "{system_message}")[len(_more) :]]
        register(Template(_name, _style, _roles, _template, _message, _sep, _sep2, _STOPS.get(_name)))


def get_template(name: str) -> Template:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}")
    return TEMPLATES[name]


def template_table(spark) -> DataFrame:
    """All templates as rows."""
    rows = [(t.name, t.style, *t.roles, t.system_template, t.system_message, t.sep, t.sep2, t.stop_str) for t in TEMPLATES.values()]
    return spark.createDataFrame(rows, "name string, style string, role0 string, role1 string, system_template string, system_message string, sep string, sep2 string, stop_str string")


def gather(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, system, turns)``: the first system text and the other turns in order."""
    all_turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    g = conversations.groupBy(key).agg(all_turns.alias("t"))
    system = F.get(F.filter("t", lambda m: m["role"] == "system"), F.lit(0))["text"]
    return g.select(key, system.alias("system"), F.filter("t", lambda m: ~m["role"].eqNullSafe(F.lit("system"))).alias("turns"))


def prompt_of(template: Template | str) -> Column:
    """The prompt of a gathered conversation (columns ``system`` and ``turns``).

    A conversation's own system text takes the place of the template's; user turns get the first
    role label, all others the second.
    """
    t = get_template(template) if isinstance(template, str) else template
    style = STYLES[t.style]
    message = F.coalesce("system", F.lit(t.system_message))
    before, _, after = t.system_template.partition("{system_message}")
    always = F.concat(F.lit(before), message, F.lit(after))
    asks_message = t.style in ("LLAMA2", "LLAMA3", "CHATGLM3", "FALCON_CHAT", "YUAN2")
    system = F.when(message == "", F.lit("")).otherwise(always) if asks_message else always
    as_col = lambda parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def piece(m: Column, i: Column) -> Column:
        turn = Turn(F.when(m["role"] == "user", F.lit(t.roles[0])).otherwise(F.lit(t.roles[1])), m["text"], i)
        return F.when(F.coalesce(m["text"], F.lit("")) == "", as_col(style.open(t, turn))).otherwise(as_col(style.said(t, turn)))

    turns = F.col("turns") if style.last is None else F.when(F.size("turns") > style.last, F.slice("turns", -style.last, style.last)).otherwise(F.col("turns"))
    return style.finish(t, F.concat(style.head(t, system), F.array_join(F.transform(turns, piece), "")))


def render(conversations: DataFrame, template: Template | str, key: str = "conv_id") -> DataFrame:
    """``(key, prompt)``: each conversation as its template writes it."""
    return gather(conversations, key).select(key, prompt_of(template).alias("prompt"))


def openai_messages(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, messages)``: system text, then turns as user and assistant by position; an open
    assistant turn is left out."""
    def message(m: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m["text"].alias("content"))

    turns = F.filter(F.transform("turns", message), lambda m: ~((m["role"] == "assistant") & m["content"].isNull()))
    head = F.when(F.coalesce("system", F.lit("")) == "", F.array().cast("array<struct<role:string,content:string>>")).otherwise(F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content"))))
    return gather(conversations, key).select(key, F.concat(head, turns).alias("messages"))


def service_messages(conversations: DataFrame, service: str, key: str = "conv_id") -> DataFrame:
    """Text message lists as other services name their parts: ``gemini``, ``vertex``, ``anthropic`` or ``reka``."""
    names = {"gemini": ("user", "model"), "vertex": (None, None), "anthropic": ("user", "assistant"), "reka": ("human", "model")}
    if service not in names:
        raise ValueError(f"no service {service!r}")
    user, model = names[service]
    if service == "vertex":  # bare texts
        return gather(conversations, key).select(key, F.filter(F.transform("turns", lambda m: m["text"]), lambda x: x.isNotNull()).alias("messages"))
    field_name = {"gemini": "parts", "anthropic": "content", "reka": "text"}[service]

    def message(m: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, F.lit(user)).otherwise(F.lit(model)).alias("role"), m["text"].alias(field_name))

    return gather(conversations, key).select(key, F.filter(F.transform("turns", message), lambda m: m[field_name].isNotNull()).alias("messages"))


def turn_pairs(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, pair_no, user, assistant)``: turns in pairs; a missing answer is null."""
    g = gather(conversations, key).where(F.size("turns") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / 2).cast("int"))
    rows = g.select(key, "turns", F.explode(starts).alias("pair_no"))
    return rows.select(key, "pair_no", F.get("turns", F.col("pair_no") * 2)["text"].alias("user"), F.get("turns", F.col("pair_no") * 2 + 1)["text"].alias("assistant"))


def append_message(conversations: DataFrame, role: str, text: str | None, key: str = "conv_id") -> DataFrame:
    """Every conversation with one more turn (a null text opens a turn)."""
    last = conversations.groupBy(key).agg((F.max("turn") + 1).alias("turn"))
    return conversations.select(key, "turn", "role", "text").union(last.select(key, "turn", F.lit(role), F.lit(text).cast("string")))


def update_last_message(conversations: DataFrame, text: str, key: str = "conv_id") -> DataFrame:
    last = conversations.groupBy(F.col(key).alias("_k")).agg(F.max("turn").alias("_last"))
    both = conversations.join(last, F.col(key) == F.col("_k"))
    return both.withColumn("text", F.when(F.col("turn") == F.col("_last"), F.lit(text)).otherwise(F.col("text"))).drop("_k", "_last")


def set_system_message(conversations: DataFrame, text: str, key: str = "conv_id") -> DataFrame:
    """Every conversation with this system text before its other turns."""
    first = conversations.groupBy(key).agg((F.min("turn") - 1).alias("turn"))
    rest = conversations.where(~F.col("role").eqNullSafe(F.lit("system"))).select(key, "turn", "role", "text")
    return first.select(key, "turn", F.lit("system").alias("role"), F.lit(text).alias("text")).union(rest)


# Images of a turn: ``images``, a list of ``(kind, value, filetype)``, kind ``url`` or ``bytes`` (value then in base64).


def image_hashes(images: Column) -> Column:
    """One text an image: a url itself, else the MD5 of the file's bytes; null for null."""
    return F.transform(images, lambda i: F.when(i["kind"] == "url", i["value"]).otherwise(F.md5(F.unbase64(i["value"]))))


def hashed_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turn, role, text, image_hashes)``: turns with hashes for images (null where a turn has none)."""
    return conversations.select(key, "turn", "role", "text", image_hashes(F.col("images")).alias("image_hashes"))


def image_files(conversations: DataFrame, folder: str = "images", saved: DataFrame | None = None) -> DataFrame:
    """``(path, data)`` of the images that turns hold as bytes, once each, less the paths in ``saved``."""
    image = conversations.select(F.explode("images").alias("i")).where("i.kind <> 'url'")
    data = F.unbase64("i.value")
    files = image.select(F.concat(F.lit(f"{folder}/"), F.md5(data), F.lit("."), F.col("i.filetype")).alias("path"), data.alias("data")).dropDuplicates(["path"])
    return files if saved is None else files.join(saved.select("path"), "path", "left_anti")


def vision_messages(conversations: DataFrame, service: str = "openai", key: str = "conv_id") -> DataFrame:
    """``(key, messages)``: as ``openai_messages``, with lists of parts as content: texts and images.

    ``openai`` names an image by its url (bytes as a data url); ``anthropic`` holds its bytes, and the
    system message even where it is empty.  Parts that a kind of content lacks are null, and absent in JSON.
    """
    if service not in ("openai", "anthropic"):
        raise ValueError(f"no service {service!r}")
    part = "struct<type:string,text:string,image_url:struct<url:string>,source:struct<type:string,media_type:string,data:string>>"

    def text_part(text: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("image_url"), F.lit(None).alias("source")).cast(part)

    def image_part(i: Column) -> Column:
        media = F.concat(F.lit("image/"), i["filetype"])
        if service == "anthropic":
            source = F.struct(F.lit("base64").alias("type"), media.alias("media_type"), i["value"].alias("data"))
            return F.struct(F.lit("image").alias("type"), F.lit(None).alias("text"), F.lit(None).alias("image_url"), source.alias("source")).cast(part)
        url = F.when(i["kind"] == "url", i["value"]).otherwise(F.concat(F.lit("data:"), media, F.lit(";base64,"), i["value"]))
        return F.struct(F.lit("image_url").alias("type"), F.lit(None).alias("text"), F.struct(url.alias("url")).alias("image_url"), F.lit(None).alias("source")).cast(part)

    none = F.array().cast(f"array<{part}>")

    def message(m: Column, i: Column) -> Column:
        images = F.when((i % 2 == 0) & m["images"].isNotNull(), F.transform(m["images"], image_part)).otherwise(none)
        return F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.concat(F.array(text_part(m["text"])), images).alias("content"))

    said = F.array_sort(F.collect_list(F.when(~F.col("role").eqNullSafe("system"), F.struct("turn", "text", "images"))))
    rows = conversations.groupBy(key).agg(F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("system"), said.alias("turns"))
    turns = F.filter(F.transform("turns", message), lambda m: ~((m["role"] == "assistant") & m["content"][0]["text"].isNull()))
    system = F.coalesce("system", F.lit(""))
    head = F.array(F.struct(F.lit("system").alias("role"), F.array(text_part(system)).alias("content")))
    if service == "openai":
        head = F.filter(head, lambda m: m["content"][0]["text"] != "")
    return rows.select(key, F.concat(head, turns).alias("messages"))
