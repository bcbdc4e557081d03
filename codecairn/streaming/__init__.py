"""The same operators on arriving files and status rows."""
