"""Plan helpers shared by the operators: scratch tables, global positions, components."""
