"""Settings of a build, in one immutable place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    relations: bool = True
    english: bool = True
    definitions: bool = True
    occupations: bool = True
    domain_words: tuple[str, ...] = ()
    ner_min_score: float = 0.40
    ner_two_pass: bool = False
    span_gate: bool = False
    emit_misc: bool = False
    relation_min_score: float = 0.5
    relation_channel: str = "auto"  #: "rules", "encoder", or "auto": the encoder where its model and an entity model can be made
    topup_when: str | None = None  #: "empty" or "sparse": which chunks may be sent to the language model
    topup_max_pct: float | None = 0.10
    topup_max_usd: float | None = None
    spaced_nouns: bool = False
    carry: bool = True
    occupation_evidence: str = "adj"
    gate_chunks: int = 500
    dedup: bool = True
    unite_chunks: bool = False
    namespace: str = "https://example.org/kg#"
    max_siblings: int = 12


#: what the caller supplies: a tokenizer and models aren't part of the package
@dataclass(frozen=True)
class Tools:
    """``tokenizer`` makes text -> [(form, tag, start, len)]; ``english_tagger`` the same with Penn tags; ``parser`` text -> dependency nodes;
    ``ner``, ``aux_ner`` (added to ``ner`` where it passes its gate) and ``english_ner`` make texts -> lists of spans; ``relation_model`` makes marked
    texts -> [(label, score)]; ``language_model`` takes a text and replies, on the driver and under the budget, ``usage`` tells the tokens
    of a reply; ``lexicon`` and ``synonyms`` are tables."""

    tokenizer: Callable | None = None
    english_tagger: Callable | None = None
    parser: Callable | None = None
    ner: Callable | None = None
    aux_ner: Callable | None = None
    english_ner: Callable | None = None
    relation_model: Callable | None = None
    language_model: Callable | None = None
    usage: Callable | None = None
    lexicon: object | None = None
    synonyms: object | None = None
