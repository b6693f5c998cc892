"""The same operators on streams of page edits."""
