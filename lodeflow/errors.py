"""Errors of the stages; all are raised before a job runs where the fault can be seen by then."""

from __future__ import annotations


class LodeflowError(Exception):
    """Base of all errors of this library."""


def _stage(name: str, what: str) -> type[LodeflowError]:
    return type(name, (LodeflowError,), {"__doc__": f"Raised when {what}.", "__module__": __name__})


LoadError = _stage("LoadError", "an input can't be read")
CleaningError = _stage("CleaningError", "a text can't be cleaned")
MetadataError = _stage("MetadataError", "metadata or headings can't be found")
ChunkingError = _stage("ChunkingError", "chunk sizes are invalid")
ExtractionError = _stage("ExtractionError", "entities or relations can't be extracted")
GraphError = _stage("GraphError", "a graph can't be built or walked")
IndexError_ = _stage("IndexError_", "an index is missing or given uneven input")
RetrievalError = _stage("RetrievalError", "weights or limits of a retriever are invalid")
RerankError = _stage("RerankError", "candidates can't be ranked again")
GenerationError = _stage("GenerationError", "an answer can't be generated")
GroundingError = _stage("GroundingError", "weights of grounding are invalid")
EvaluationError = _stage("EvaluationError", "samples can't be aligned or tested")
StoreError = _stage("StoreError", "a version can't be committed")
