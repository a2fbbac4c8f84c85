"""Derived words and their XML, made for the many documents of an Arrow batch at once.

The functions travel with the job, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column

from reviewlens.functions.small_parts import in_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RELATIONS = ["SBV", "ADV", "HED", "ATT", "COO", "VOB"]
POS = ["n", "a", "v", "d"]
#: From a word to its head, by the word's number modulo 24; a word without one has the parent -1.
HEAD_STEPS = [step for coordinated in (-2, -4, -8, -16) for step in (2, 1, None, -1, coordinated, -3)]
NAMES = ["id", "cont", "pos", "ne", "parent", "relate"]
WORD = "struct<id:int,cont:string,pos:string,ne:string,parent:int,relate:string>"
#: Bytes of text that are answered in one go, as words or XML, and bytes of words as XML.
TEXT_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 8_000_000
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;")]


def offsets_of(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def sizes_of(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def relisted(values: pa.Array, lists: pa.Array) -> pa.Array:
    """The values in lists as long as those given, null where these are."""
    return pa.ListArray.from_arrays(offsets_of(sizes_of(lists)), values, mask=lists.is_null())


def words_of(lists: pa.Array) -> pa.Array:
    """The words of each clause with their derived places, tags and relations."""
    sizes, cont = sizes_of(lists), lists.flatten()
    i = np.arange(len(cont)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    steps = np.array([0 if step is None else step for step in HEAD_STEPS])
    has_head = np.array([step is not None for step in HEAD_STEPS])
    n_chars = pc.utf8_length(cont).fill_null(0).to_numpy(zero_copy_only=False)
    columns = [
        pa.array(i, pa.int32()),
        cont,
        pa.array(POS).take(pa.array((n_chars + i) % len(POS))),
        pa.array(["O"]).take(pa.array(np.zeros(len(cont), np.int64))),
        pa.array(np.where(has_head[i % 24], i + steps[i % 24], -1), pa.int32()),
        pa.array(RELATIONS).take(pa.array(i % len(RELATIONS))),
    ]
    return relisted(pa.StructArray.from_arrays(columns, NAMES), lists)


def clauses_of(lists: pa.Array) -> pa.Array:
    """The clauses of each document, given their numbers and texts, words with blanks between them."""
    flat = lists.flatten()
    words = pc.split_pattern_regex(flat.field("content"), " +")
    columns = [flat.field("sId"), words_of(words)]
    return relisted(pa.StructArray.from_arrays(columns, ["sId", "sDpResult"]), lists)


def escaped(values: pa.Array) -> pa.Array:
    odd = pc.match_substring_regex(values, '[&<>"\t]')
    if not pc.any(odd).as_py():
        return values
    some = values.filter(odd)
    for sign, entity in ESCAPES:
        some = pc.replace_substring(some, sign, entity)
    return pc.replace_with_mask(values, odd, some)


def joined(lists: pa.Array, tags: pa.Array) -> pa.Array:
    return pc.binary_join(relisted(tags, lists), "")


def xml_of(parses: pa.Array) -> pa.Array:
    """The clauses of each document as the XML an analysis service answers with."""
    sentences = parses.flatten()
    lists = sentences.field("sDpResult")
    words = lists.flatten()
    pieces: list = ["<word"]
    for name in NAMES:
        value = words.field(name)
        value = escaped(value) if name == "cont" else pc.cast(value, pa.string())
        pieces += [f' {name}="', value, '"']
    tags = pc.binary_join_element_wise(*pieces, "/>", "")
    s_id = pc.cast(sentences.field("sId"), pa.string())
    body = pc.binary_join_element_wise('<sent id="', s_id, '">', joined(lists, tags), "</sent>", "")
    return pc.binary_join_element_wise(
        '<xml4nlp><doc><para id="0">', joined(parses, body), "</para></doc></xml4nlp>", ""
    )


def xml_of_derived(lists: pa.Array) -> pa.Array:
    """The XML of the derived clauses of each document."""
    return xml_of(clauses_of(lists))


def derived_clauses(clauses: Column) -> Column:
    """The parsed clauses of a document, given their ``sId`` and trimmed ``content``."""
    return in_parts(clauses_of, f"array<struct<sId:int,sDpResult:array<{WORD}>>>", TEXT_AT_ONCE, clauses)


def derived_xml(clauses: Column) -> Column:
    """``parse_xml`` of ``derived_clauses``, without the words in between."""
    return in_parts(xml_of_derived, "string", TEXT_AT_ONCE, clauses)


def parse_xml(clauses: Column) -> Column:
    """The parsed clauses of a document as XML."""
    return in_parts(xml_of, "string", WORDS_AT_ONCE, clauses)
