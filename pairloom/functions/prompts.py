"""Prompt texts and chat structures, rendered by column expressions.

Each template is text with one ``{source}`` place. A table of (form, task) ->
text keeps the wording apart from the code; callers may pass their own table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import strip, task_of, unmarked

# The prompt wording that trained models expect, with clean whitespace.
_OPENING = (
    "Below is an instruction that describes a task, paired with an input that provides further context.\n"
    "Write a response that appropriately completes the request."
)
_DETAIL = "are given against the following input. You should be as detailed as possible."
INSTRUCTIONS = {
    "mol2cap": "You are a researcher. You can come up captions based on your existing knowledge.\n"
    f"Captions {_DETAIL}",
    "cap2mol": "You are a researcher. You can come up molecule smile strings based on your existing knowledge.\n"
    f"Molecule smile strings {_DETAIL}",
}
INPUTS = {
    "mol2cap": "Molecule: {source}\nIn that molecule, could you formulate a caption about?",
    "cap2mol": "Caption: {source}\nIn that caption, could you generate a molecule smile string?",
}
TRANSLATE_PREFIX = {
    "mol2cap": "Translate the following molecule smile string to a descriptive caption: ",
    "cap2mol": "Translate the following descriptive caption to a molecule smile string: ",
}
TASK_INSTRUCTION = {
    "mol2cap": "Generate a caption given a molecule: ",
    "cap2mol": "Generate a molecule given a description: ",
}
SYSTEM_MESSAGE = (
    "This is a competitive yet complementary shared task based on 'translating' "
    "between molecules and natural language."
)
CHAT_BEGIN, CHAT_END = "<|im_start|>", "<|im_end|>"

TASKS = ("mol2cap", "cap2mol")
PREFERENCE = {
    task: f"{_OPENING}\n\n### Instruction:\n{INSTRUCTIONS[task]}\n\n### Input:\n{INPUTS[task]}\n\n### Response:"
    for task in TASKS
}
INFERENCE = {
    task: f"{_OPENING}\n\n### Instruction:\n{INSTRUCTIONS[task].replace(chr(10), ' ')}\n\n"
    f"### Input:\n{INPUTS[task]}\n\n### Response:"
    for task in TASKS
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render(template: str, source: Column | str) -> Column:
    """The template with its place filled; the source is inserted as it is."""
    before, _, after = template.partition("{source}")
    return F.concat(F.lit(before), _col(source), F.lit(after))


def by_task(task: Column | str, values: dict[str, Column]) -> Column:
    """The task's value; NULL for an unknown task."""
    task = _col(task)
    chosen = None
    for name, value in values.items():
        chosen = F.when(task == name, value) if chosen is None else chosen.when(task == name, value)
    return chosen


def rendered_by_task(templates: dict[str, str], task: Column | str, source: Column | str) -> Column:
    return by_task(task, {name: render(text, source) for name, text in templates.items()})


def prompt_of_marked(source: Column | str, templates: dict[str, str] = PREFERENCE) -> Column:
    """Prompt of a text that carries its task marker; NULL without a marker."""
    return rendered_by_task(templates, task_of(source), unmarked(source))


def instruction_parts(source: Column | str, target: Column | str) -> Column:
    """``struct(instruction, input, output)`` of a marked source and its target."""
    task, body = task_of(source), unmarked(source)
    return F.struct(
        by_task(task, {t: F.lit(INSTRUCTIONS[t]) for t in TASKS}).alias("instruction"),
        rendered_by_task(INPUTS, task, body).alias("input"),
        _col(target).alias("output"),
    )


def instruction_text(instruction: Column | str, input: Column | str, output: Column | str) -> Column:
    """One training text of the three parts, edges stripped."""
    return strip(F.concat(
        F.lit(f"{_OPENING}\n\n### Instruction:\n"), _col(instruction),
        F.lit("\n\n### Input:\n"), _col(input),
        F.lit("\n\n### Response:\n"), _col(output),
    ))


def prefixed(task: Column | str, source: Column | str) -> Column:
    """The fixed translation prefix of the task, then the source."""
    return rendered_by_task({t: TRANSLATE_PREFIX[t] + "{source}" for t in TASKS}, task, source)


def with_end(completion: Column | str, end_mark: str = "</s>") -> Column:
    return F.concat(_col(completion), F.lit(end_mark))


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), _col(content).alias("content"))


def chat(*messages: Column) -> Column:
    """``array<struct<role, content>>`` in the given order."""
    return F.array(*messages)


def chat_text(messages: Column | str, generation_prompt: bool = False, begin: str = CHAT_BEGIN, end: str = CHAT_END) -> Column:
    """The messages as one marked-up text, optionally opening the assistant's turn."""
    parts = F.transform(
        _col(messages),
        lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n")),
    )
    tail = F.lit(f"{begin}assistant\n" if generation_prompt else "")
    return F.concat(F.array_join(parts, ""), tail)
