"""Chat templates as expressions, against texts that the layouts' authors show."""

import pytest
from pyspark.sql import functions as F

from chatprep.functions.chat_template import TemplateError, render_template
from chatprep.operators.chat import render_chat
from tests.helpers import plan

CHATML = (
    "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}"
    "{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)
TAGGED = """{% for message in messages %}
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
BRACKETS = (
    "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}"
    "{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}"
    "{% for message in loop_messages %}"
    "{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('Conversation roles must alternate') }}{% endif %}"
    "{% if loop.index0 == 0 and system_message %}{% set content = '<<SYS>>\\n' + system_message + '\\n<</SYS>>\\n\\n' + message['content'] %}"
    "{% else %}{% set content = message['content'] %}{% endif %}"
    "{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content | trim + ' [/INST]' }}"
    "{% elif message.role == 'assistant' %}{{ ' '  + content.strip() + ' ' + eos_token }}{% endif %}{% endfor %}"
)
TALK = [("system", "Be brief."), ("user", " Hi \n"), ("assistant", "Hello.\n"), ("user", "Bye")]


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(1, [{"role": r, "content": c} for r, c in TALK]), (2, [{"role": r, "content": c} for r, c in TALK[1:]]), (3, []), (4, None)]
    return spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")


def _texts(talks, template, **how):
    found = talks.select("id", render_template(F.col("messages"), template, **how).alias("text"))
    assert "Python" not in plan(found)
    return {r.id: r.text for r in found.collect()}


def test_chatml(talks):
    for prompt in (False, True):
        same = {r.id: r.t for r in talks.select("id", render_chat(F.col("messages"), prompt).alias("t")).collect()}
        assert _texts(talks, CHATML, add_generation_prompt=prompt) == same


def test_tagged(talks):
    got = _texts(talks, TAGGED, add_generation_prompt=True, eos_token="</s>")
    assert got[1] == "<|system|>\nBe brief.</s>\n<|user|>\n Hi \n</s>\n<|assistant|>\nHello.\n</s>\n<|user|>\nBye</s>\n<|assistant|>\n"
    assert got[3] == "" and got[4] is None
    by_row = _texts(talks, TAGGED, add_generation_prompt=F.col("id") == 1, eos_token="</s>")
    assert by_row[1] == got[1] and by_row[2] + "<|assistant|>\n" == got[2]


def test_brackets(talks):
    some = talks.where("id IN (1, 2)")
    got = _texts(some, BRACKETS, bos_token="<s>", eos_token="</s>")
    assert got[1] == "<s>[INST] <<SYS>>\nBe brief.\n<</SYS>>\n\n Hi [/INST] Hello. </s><s>[INST] Bye [/INST]"
    assert got[2] == "<s>[INST] Hi [/INST] Hello. </s><s>[INST] Bye [/INST]"


def test_roles_that_do_not_alternate(spark):
    rows = [(1, [{"role": "assistant", "content": "x"}])]
    talks = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="Conversation roles must alternate"):
        _texts(talks, BRACKETS, bos_token="", eos_token="")


@pytest.mark.parametrize(
    "template, text",
    [
        ("a  {%- if true -%}  b  {%- endif %} c", "ab c"),
        ("a\n  {% if true %}\n  b\n  {% endif %}\nc", "a\n  b\nc"),
        ("{{ 'x' }}\n{{- 'y' -}}\n z", "xyz"),
        ("{# note #}{{ messages | length }}{{ messages[-1].content }}", "4Bye"),
        ("{% for m in messages[2:] %}{{ loop.index }}{{ m.role | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", "1ASSISTANT, 2USER"),
        ("{{ missing }}{% if missing is defined %}no{% else %}yes{% endif %}{% if messages[0].tool_calls is not defined %}!{% endif %}", "yes!"),
        ("{% if 'brief' in messages[0].content and not 'x' in 'abc' %}{{ 1 + 2 ~ '' }}{% endif %}", "3"),
        ("{% set a = 'p' %}{% if false %}{% set a = 'q' %}{% endif %}{{ a }}{{ none }}{{ 7 % 4 == 3 }}", "pNoneTrue"),
        ("{{ messages[9].content is none }}{{ 'A' ~ 1 == 'A1' }}{{ \"it's\" }}", "TrueTrueit's"),
        ("{{ 'é\\n\\t' }}", "é\n\t"),
        ("plain", "plain"),
    ],
)
def test_constructs(talks, template, text):
    assert _texts(talks.where("id = 1"), template)[1] == text


@pytest.mark.parametrize(
    "template",
    [
        "{% macro x() %}{% endmacro %}",
        "{% for m in messages %}{{ m.content }}",
        "{% endfor %}",
        "{% for m in tools %}{% endfor %}",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}",
        "{{ messages | tojson }}",
        "{{ strftime_now('%d') }}",
        "{{ messages[:-1] }}",
        "{{ 'a' + 1 }}",
        "{{ 'a' 'b' }}",
        "{{ a ? b }}",
        "{{ messages }}",
        "{{ 'x'.split('y') }}",
        "{% set ns = namespace(found=false) %}",
        "{% if true %}",
        "{{ 1 < 'a' }}",
    ],
)
def test_other_constructs_are_errors(talks, template):
    with pytest.raises(TemplateError):
        render_template(F.col("messages"), template)
