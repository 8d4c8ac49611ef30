"""From schema text to a resolved graph of types, on the driver."""
