"""Part of tidewell: see the README for the layout."""
