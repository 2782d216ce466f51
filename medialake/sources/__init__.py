"""Reading libraries: listings, lists, tag maps, caches; and writing what the engine decides."""
