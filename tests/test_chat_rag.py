import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import chat as C
from corpusgraph.operators import chunking as K
from corpusgraph.operators import embedding as E
from corpusgraph.operators import rag as R
from corpusgraph.service import SearchService

ROWS = [(1, 0, "system", "Sys."), (1, 1, "user", "Hi\n\nyou"), (1, 2, "assistant", "Yo"), (1, 3, "user", "Bye"), (1, 4, "assistant", None), (2, 0, "user", "Only")]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")


#: Prompts of conversation 1, written out by hand from the formats' descriptions.
WANT = {
    "chatml": "<|im_start|>system\nSys.<|im_end|>\n<|im_start|>user\nHi\n\nyou<|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n<|im_start|>user\nBye<|im_end|>\n<|im_start|>assistant\n",
    "mistral": "[INST] Sys.\nHi\n\nyou [/INST] Yo</s>[INST] Bye [/INST]",
    "vicuna_v1.1": "Sys. USER: Hi\n\nyou ASSISTANT: Yo</s>USER: Bye ASSISTANT:",
    "llama-3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nSys.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nHi\n\nyou<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nYo<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nBye<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "falcon": "Sys.User: Hi\nyou\n\nAssistant: Yo\n\nUser: Bye\n\nAssistant:",
    "chatglm2": "Sys.\n\n[Round 1]\n\n问：Hi\n\nyou\n\n答：Yo\n\n[Round 2]\n\n问：Bye\n\n答：",
    "internlm-chat": "Sys.<s><|User|>:Hi\n\nyou<eoh>\n<|Bot|>:Yo<eoa>\n<s><|User|>:Bye<eoh>\n<|Bot|>:",
    "dolly_v2": "Sys.### Instruction:\nHi\n\nyou\n\n### Response:\nYo### End\n\n### Instruction:\nBye\n\n### Response:\n",
    "phoenix": "Sys.Human: <s>Hi\n\nyou</s>Assistant: <s>Yo</s>Human: <s>Bye</s>Assistant: <s>",
    "metamath": "Sys.\n\n### Instruction:\nHi\n\nyou\n\n### Response: Let's think step by step.Yo### Instruction:\nBye\n\n### Response: Let's think step by step.",
    "yuan2": "Sys.\nHi\n\nyou<n>Yo<n>Bye<sep>",
    "gemma": "<bos><start_of_turn>user\nHi\n\nyou<end_of_turn>\n<start_of_turn>model\nYo<end_of_turn>\n<start_of_turn>user\nBye<end_of_turn>\n<start_of_turn>model\n",
    "cllm": "Sys. USER: Bye ASSISTANT:",
    "falcon-chat": "System: Sys.\nUser: Hi\n\nyou\nFalcon: Yo\nUser: Bye\nFalcon:",
    "raw": "Sys.Hi\n\nyouYoBye",
    "tulu": "Sys.\n<|user|>\nHi\n\nyou\n<|assistant|>\nYo\n<|user|>\nBye\n<|assistant|>\n",
    "api_based_default": "Sys.\nuser: Hi\n\nyou\nassistant: Yo\nuser: Bye\nassistant:",
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_prompts(conv, name):
    assert {r.conv_id: r.prompt for r in C.render(conv, name).collect()}[1] == WANT[name]


def test_every_style_has_a_template(conv):
    assert {t.style for t in C.TEMPLATES.values()} == set(C.STYLES)
    with pytest.raises(ValueError):
        C.register(C.get_template("mistral"))
    with pytest.raises(KeyError):
        C.get_template("absent")


def test_message_lists_and_edits(spark, conv):
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in C.openai_messages(conv).collect()}
    assert got[1] == [("system", "Sys."), ("user", "Hi\n\nyou"), ("assistant", "Yo"), ("user", "Bye")] and got[2] == [("user", "Only")]
    assert {r.conv_id: [tuple(m) for m in r.messages] for r in C.service_messages(conv, "reka").collect()}[1][1] == ("model", "Yo")
    pairs = sorted((r.conv_id, r.pair_no, r.user, r.assistant) for r in C.turn_pairs(conv).collect())
    assert pairs == [(1, 0, "Hi\n\nyou", "Yo"), (1, 1, "Bye", None), (2, 0, "Only", None)]
    c = C.update_last_message(C.append_message(conv, "assistant", None), "Done")
    assert c.where("text = 'Done'").count() == 2 and C.set_system_message(conv, "S").where("role = 'system'").count() == 2
    assert C.template_table(spark).count() == len(C.TEMPLATES)


def test_parsers(spark):
    rows = [("Question: q?\nAnswer: a", "stop"), ("no marks", "stop"), ("Evaluation: fine\nTotal rating: 4", "length"), ("Evaluation: fine\nTotal rating: 4", "stop"), ("x [RESULT] 3 [RESULT] 5 ", "stop")]
    df = spark.createDataFrame(rows, "c string, f string")
    q, a = R.parse_qa(F.col("c"))
    s, e = R.parse_critique(F.col("c"), F.col("f"))
    got = df.select(q.alias("q"), a.alias("a"), s.alias("s"), e.alias("e"), R.parse_judge(F.col("c")).alias("j")).collect()
    assert (got[0].q, got[0].a) == ("q?", "a") and got[1].q is None
    assert (got[2].s, got[2].e) == ("0", "") and (got[3].s, got[3].e) == ("4", "fine") and got[4].j == "5"
    ok = R.passes_critiques(F.lit("2"), F.lit("4/5"), F.lit(None).cast("string"))
    assert not df.select(ok.alias("v")).first().v and df.select(R.passes_critiques(F.lit("2"), F.lit("3")).alias("v")).first().v


def test_chunks(spark):
    words = [f"w{i}" for i in range(600)]
    got = K.chunk_text(" ".join(words))
    assert got[0] == " ".join(words[:256]) and got[1].split()[0] == "w231" and got[-1].endswith("w599")
    assert K.chunk_text("") == K.chunk_text(None) == [""]
    assert K.chunk_text("abcdef", 2, 0, len, ()) == ["ab", "cd", "ef"]
    with pytest.raises(ValueError):
        K.chunk_text("a", 2, 3)
    df = spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_no) for r in K.chunk_documents(df).orderBy("doc_id", "chunk_no").collect()] == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_service_answers_and_refuses(spark, tmp_path):
    texts = ["interest rates rise slowly", "interest rates fall", "prices rise", "the weather is fine"]
    nodes = E.embed(spark.createDataFrame([(i, f"d{i // 2}.pdf", t) for i, t in enumerate(texts)], "node_id long, file_name string, text string"), "text")
    edges = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.3), (2, 3, 0.2)], "src long, dst long, weight double")
    s = SearchService(spark, nodes, edges)
    assert [r.file_name for r in s.documents().collect()] == ["d0.pdf", "d1.pdf"]
    row = s.search("interest rates fall", "d0.pdf", k=2).first()
    assert row.node_id == 1 and row.context.startswith(" Context 1: ") and row.answer.startswith("Question: ") is True
    with pytest.raises(ValueError):
        s.search("x", "absent.pdf")
    s.feedback({"rating": 4, "answer": "a"}, str(tmp_path / "fb"))
    assert spark.read.parquet(str(tmp_path / "fb")).first().rating == "4"
    with pytest.raises(ValueError):
        s.feedback({"answer": "a"}, str(tmp_path / "fb"))
