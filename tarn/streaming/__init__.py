"""Streaming: the batch operators hold no state of their own, so none is needed here; see the README."""
