"""Tables as labelled matrices."""
