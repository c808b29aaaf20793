"""Tests of the text operators; the folder goes with them."""
