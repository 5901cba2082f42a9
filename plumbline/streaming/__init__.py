"""An extension beside the batch operators: the change log and the ratchet over streams."""
